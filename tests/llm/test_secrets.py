from __future__ import annotations

import base64
import hashlib
import random
import re

from cutline.llm.secrets import ASSIGN, masked, secret_spans
from tests.llm.conftest import LONG

PLAIN = re.compile(ASSIGN)


def base(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in PLAIN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in spans)


KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
CASES = [
    None, "", "nothing here", f'token = "{KEY}"', f"PassWord:{KEY} and AKIA" + "Q7" * 8 + " end", "secret=abc secret=abcdef", "token:token:abcdef", "token=api_key=abcdefgh",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "a" * 23 + " " + "b" * 24 + "g" + "c" * 30, "é𝄞 api-key: x apikey: 123456 ünï", "passwd\" : 'hunter22' \n API_KEY=______", LONG + "token=" + KEY,
    "ſecret=abcdefg toKen=abcdefg", "akia" + "0" * 20, f"x{KEY}y", "password=" + "=" * 6,
]


def test_fixed_patterns(documents):
    docs = documents([(i, t) for i, t in enumerate(CASES)] + [(0, "again " + KEY), (None, KEY)], ("base", "tested", "spans", "start"))
    got = {}
    for r in secret_spans(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[0]) == 2 and got[None][0]["n_hex"] == 1
    for i, t in enumerate(CASES):
        want = base(t)
        r = got[i][0] if i else next(x for x in got[0] if x["n_hex"] == 0)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == c for _, k, _ in want) for c in range(3)], t
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest(), t
        assert set(filter(None, joined(want).split(","))) <= set(r["spans"].split(","))
    assert secret_spans(documents([])).count() == 0


def test_random_strings_are_found_and_words_are_not(documents):
    rng = random.Random(9)
    keys = [base64.b64encode(rng.randbytes(48)).decode().rstrip("=") for _ in range(30)]
    plain = ["this_is_a_very_long_identifier_name_2", "2020-01-01-2020-01-02-2020-01-03a", "getElementsByClassNameAndTagName2", "aaaaaaaaaaaaaaaaaaaa1111111111"] * 10
    docs = documents([(i, f"see {k} there") for i, k in enumerate(keys)] + [(100 + i, f"see {k} there") for i, k in enumerate(plain)])
    got = {r["doc_id"]: r["spans"] for r in secret_spans(docs).collect()}
    assert sum(got[i] == f"random:4:{4 + len(k)}" for i, k in enumerate(keys)) >= 28
    assert not any("random" in got[100 + i] for i in range(len(plain)))


def test_masking(documents):
    docs = documents([(1, f"é token={KEY} end"), (2, "clean text"), (3, None), (4, f"{KEY} {KEY}")], ("_base", "_spans", "_tested"))
    out = masked(docs)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.columns == docs.columns
    assert got[1] == ("é [secret] end", len("é [secret] end")) and got[4][0] == "[secret] [secret]"
    assert got[2] == ("clean text", 10) and got[3] == (None, 0)
    assert masked(documents([])).count() == 0
