"""Base spans against plain matching; what the models add."""

import hashlib
import random
import re
import string

from llm_data import docs_table, edge_rows, words

from wattloom.llm import secrets

KINDS = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def brute_force(text):
    spans = []
    for rank, (kind, pattern, good) in enumerate(KINDS):
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if good(m)]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def texts():
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    out = []
    for k in range(80):
        syllables = ["ver", "ant", "wort", "lich", "keit", "tion", "schaft", "ment", "able", "ung", "ent", "is"]
        parts = words(20, k) + ["".join(rng.choice(syllables) for _ in range(rng.randrange(3, 7))) for _ in range(20)] + ["Umweltverträglichkeitsprüfung", "internationalization", "responsibilitiesandmore"]
        extra = [
            f"password={hexes(18)}", f'Token = "{hexes(40)}"', "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16)),
            hexes(40), "secret=token:abcdefgh", "pAsSwD:short", "API_KEY='abc.def=='", "AKIAAKIA" + "Z" * 13, "é" + hexes(30) + "g",
        ]
        for x in rng.sample(extra, k % 5):
            parts.insert(rng.randrange(len(parts)), x)
        out.append((k, ("\n" if k % 2 else " ").join(parts)))
    return out


def test_base_spans_equal_plain_matching(spark):
    rows = texts() + [(d if d is None else d + 500, t) for d, t in edge_rows()] + [(900, "password=" + "a" * 50_000 + " " + "token=abcdef " * 300)]
    for r in zip(sorted(rows, key=repr), sorted(secrets.secrets(docs_table(spark, rows)).collect(), key=lambda r: repr((r.doc_id, dict(rows).get(r.doc_id))))):
        (doc_id, text), got = r
        want = brute_force(text)
        assert got.doc_id == doc_id
        assert got.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(s[3] == k for s in want) for k in ("assign", "access", "hex"))
        assert set(joined(want).split(",")) - {""} <= set(got.spans.split(","))


def test_models_add_random_strings_and_leave_words(spark):
    rng = random.Random(1)
    odd = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    rows = texts() + [(200, f"here is {odd} alone"), (201, "a verantwortlichkeitungen in here"), (202, "internationalizationresponsibilities")]
    got = {r.doc_id: r for r in secrets.secrets(docs_table(spark, rows)).collect()}
    assert got[200].spans == "random:8:48"
    assert got[201].spans == got[202].spans == ""
    assert secrets.secrets(docs_table(spark, rows[-3:])).where("spans <> ''").count() == 0


def test_empty_table_and_native_plan(spark, capsys):
    assert secrets.secrets(docs_table(spark, [])).count() == 0
    secrets.secrets(docs_table(spark, [(1, "a")])).explain()
    assert "Python" not in capsys.readouterr().out
