"""Secret scan against regular expressions on text and windows counted one by one."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm import secret_scan as S
from llm.queries import op12_secret_scan

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "wJ4rXUtnFEMIbK7MDENGbPxRfiCYzz3K9qTd81Lv"


def fixed(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], S.FIXED.index(s[0])))


def dense(data, kinds):
    out = []
    for k in kinds:
        spans = []
        for a in range(len(data) - k.window + 1):
            w = data[a : a + k.window]
            if all(c in k.symbols for c in w) and any(48 <= c < 58 for c in w) and any(chr(c).isalpha() for c in w):
                if -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values()) >= k.bits - 1e-9:
                    if spans and spans[-1][1] >= a:
                        spans[-1][1] = a + k.window
                    else:
                        spans.append([a, a + k.window])
        out += [(k.name, *s) for s in spans]
    return out


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
def test_windows(block):
    r = random.Random(block)
    scanner, alphabet = S.Scanner(block=block), b"abcdef0123456789ABCXYZxyz+/ gh"
    for _ in range(80):
        data = bytes(r.choice(alphabet[: r.choice([16, 22, 30])]) for _ in range(r.randrange(0, 200)))
        assert scanner.dense(np.frombuffer(data, np.uint8)) == dense(data, S.KINDS)


def test_fixed_kinds():
    r = random.Random(5)
    bits = ["password", "Passwd=", "SECRET : ", "token", "api_key", "apikey'", '="', "AKIA", "ABCDEF0123456789", "deadbeef" * 4, "0" * 23, " ", "ü", "ſecret=abcdefg", "toKen=abcdefgh", "abc123", ".", "\n", "x="]
    scanner = S.Scanner()
    for _ in range(400):
        text = "".join(r.choices(bits, k=r.randrange(0, 14)))
        got = [s for s in scanner.scan(np.frombuffer(text.encode(), np.uint8)) if s[0] in S.FIXED]
        assert got == fixed(text)


def test_added_spans_and_what_explains_them():
    scanner = S.Scanner(strings=(KEY[::-1],))
    found = lambda t: [(k, t[a:b]) for k, a, b in scanner.scan(np.frombuffer(t.encode(), np.uint8))]
    (kind, got), = found(f"größe: {KEY} end")
    assert kind == "entropy_base64" and got in KEY and len(got) >= 30
    assert "entropy_hex" in [k for k, _ in found(f"x = 3F9A{'0B7C45D1E8' * 3} y")]
    for clean in (
        f"see https://example.org/{KEY} now", f"sha256:{KEY}", "id 123e4567-e89b-12d3-a456-426614174000", "abcdefghijklmnopqrstuvwxyz0123456789", f"a {KEY[::-1]} b",
        "Donaudampfschifffahrtsgesellschaftskapitän", "4785380592391139 2123465659789240", f"EXAMPLE{KEY}", "https://www.site.net/a/b?c=1234567890abcdef&d=Ff09Zz18Yy27Xx36Ww45",
    ):
        assert found(clean) == [], clean
    assert [k for k, _ in found(f"token = {KEY}")] == ["assign"]  # inside a fixed span


def test_rows(spark):
    text = f"ü password='hunter22' {KEY}\n" + "0123456789abcdef" * 2
    long = "word " * 100_000 + text
    rows = [(1, text), (2, None), (3, ""), (4, long), (1, text), (None, text)]
    docs = spark.createDataFrame([(t, k, "s") for k, t in rows], "text string, doc_id long, spans string")
    got = S.secrets(docs).collect()
    assert len(got) == len(rows) and S.secrets(docs.limit(0)).count() == 0
    for r in got:
        known = {1: text, 4: long, None: text}.get(r.doc_id) or ""
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in S.FIXED] == fixed(known)
        assert [known[s.start : s.end] in KEY for s in r.spans if s.kind not in S.FIXED] == [True] * (1 if known else 0)
    hidden = S.redacted(S.secrets(docs).filter("doc_id = 1").limit(1).withColumnRenamed("doc_id", "d").join(docs.filter("doc_id = 1").limit(1).drop("spans"))).first()
    assert "hunter22" not in hidden.text and KEY[:30] not in hidden.text and hidden.text.startswith("ü [secret]")


def test_registered_rows(spark):
    data = "/root/testdata/sf0.001"
    known = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = op12_secret_scan(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(known)
    for r in got:
        spans = fixed(known[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in S.FIXED)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(","))
