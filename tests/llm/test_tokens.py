"""Token files: exact round trip, selective reading, checksums."""

import zlib

import numpy as np
import pytest
from llm_data import docs_table, edge_rows

from wattloom.llm import tokens
from wattloom.llm.queries import END_ID, tokenizer_path


def expected(rows):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    start = 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = tool.encode(text or "", add_special_tokens=False).ids + [END_ID]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_round_trip_equals_the_tokenizer(spark):
    texts = ["It's a test,\nthe second\tline isn't", "", None, "<|endoftext|> inside", "é é Ñandú ΣΑΣ 12.5", "x" * 5000, " a  b \n", "The END. don't stop!! wait... (A,B); X1, 3.5, O'Neil's: q? <|ENDOFTEXT|>, J\u030c."]
    rows = [(i * 3 % 8, t) for i, t in enumerate(texts)]
    folder, index = tokens.write_tokens(docs_table(spark, rows), tokenizer_path(), END_ID, frame_ids=8)
    got = tokens.read_tokens(spark, folder, index)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == sorted(expected(rows))


def test_edge_rows_keep_one_entry_per_row(spark):
    rows = edge_rows()
    folder, index = tokens.write_tokens(docs_table(spark, rows), tokenizer_path(), END_ID)
    got = tokens.read_tokens(spark, folder, index).collect()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == list(np.cumsum([0] + [r.n_tokens for r in by_start])[:-1])
    ids = [r.doc_id for r in by_start]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_wanted_documents_and_empty_table(spark):
    rows = [(i, f"document number {i} " * (i + 1)) for i in range(40)]
    folder, index = tokens.write_tokens(docs_table(spark, rows), tokenizer_path(), END_ID, frame_ids=64)
    wanted = spark.createDataFrame([(7,), (31,), (99,)], "doc_id long")
    got = tokens.read_tokens(spark, folder, index, wanted).collect()
    want = {d: (s, n, c) for d, s, n, c in expected(rows)}
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == {d: want[d] for d in (7, 31)}
    folder, index = tokens.write_tokens(docs_table(spark, []), tokenizer_path(), END_ID)
    assert tokens.read_tokens(spark, folder, index).count() == 0


def test_damage_is_noticed_and_other_frames_stay_readable(tmp_path):
    from pyarrow.fs import LocalFileSystem

    path = str(tmp_path / "a.zst")
    storage = LocalFileSystem()
    with storage.open_output_stream(path, compression=None) as sink:
        writer = tokens.FrameWriter(sink, "<u2", 4)
        for k in range(6):
            writer.add(k, np.arange(k, k + 4, dtype="<u2").tobytes())
        writer.close()
    data = bytearray(open(path, "rb").read())
    with storage.open_input_file(path) as source:
        good = tokens.TokenFile(source)
        assert [e.ids.tolist() for e in good.read([1, 5])] == [[1, 2, 3, 4], [5, 6, 7, 8]]
        at = int(good.offset[2])
    data[at + 8] ^= 0xFF
    open(path, "wb").write(data)
    with storage.open_input_file(path) as source:
        damaged = tokens.TokenFile(source)
        assert [e.doc_id for e in damaged.read([0, 4])] == [0, 4]
        with pytest.raises(Exception):
            list(damaged.read([2]))


def test_short_path_equals_the_tokenizer():
    """Pieces of all kinds of characters, alone and mixed, over caches that turn over."""
    import random
    import unicodedata

    from hypothesis import given, settings, strategies as st
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    encode = tokens.Encoder(tokenizer_path(), "<u2")
    assert encode.plain
    encode.pieces.limit = encode.cuts.limit = 50

    def same(texts):
        assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts)] == [
            tool.encode(t, add_special_tokens=False).ids for t in texts
        ]

    kinds = {}
    for k in range(0x110000):
        kinds.setdefault(unicodedata.category(chr(k)), []).append(chr(k))
    kinds.pop("Cs")
    every = st.sampled_from(sorted(kinds)).flatmap(lambda c: st.sampled_from(kinds[c][:4000]))
    latin = st.sampled_from([chr(k) for k in range(0x20, 0x250)])
    piece = st.text(st.one_of(latin, latin, every), max_size=12)
    ends = st.sampled_from(["'s", "'RE", "don't", "<|endoftext|>", "<|", "\n", "  ", "\t", "́", "İ", "\xb5", "\x85"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(st.one_of(piece, ends), max_size=8).map("".join), max_size=5))
    def check(texts):
        same(texts)

    check()
    pick = random.Random(1)
    latin1 = [chr(k) for k in range(0x21, 0x100)]
    same([" ".join("".join(pick.choices(latin1, k=pick.randrange(1, 9))) for _ in range(500)) for _ in range(6)])
    same([chr(a) + chr(b) for a in range(0x21, 0x100, 3) for b in range(0x21, 0x100)])
