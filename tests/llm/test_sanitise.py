"""Personal data: patterns against plain regular expressions, disclosure against counts made row by row, whole spans."""
from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from hourgrid.llm import queries
from hourgrid.llm import sanitise as S

SF = "/root/testdata/sf0.01"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_base(text: str) -> list[tuple]:
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PLAIN).index(s[0])))


@settings(deadline=None, max_examples=1500)
@given(st.text(alphabet="a.@-1 +(0)2é%_X\n4", max_size=60))
def test_patterns(text):
    assert S.base_spans(text) == plain_base(text)


def test_patterns_on_numbers():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["4", "12", "255", "256", ".", ".", " ", "-", "+1 ", "(", ") ", "x", "999", "@a.b"])
                       for _ in range(rng.randrange(40)))
        assert S.base_spans(text) == plain_base(text)
    for card in ("4539 1488 0343 6467", "4539148803436467", "4539-1488-0343-6468"):
        assert S.base_spans(card) == plain_base(card)
    assert {k for k, *_ in S.base_spans("4539 1488 0343 6467")} == {"card"}
    for long in ("1" * 200000, "a" * 200000, "1." * 100000, "@" * 50000, "+1" + "(" * 100000, "a.b@" * 40000):
        S.base_spans(long)  # linear in the text


def plain_spans(texts: list[str], support: int = 3) -> list[list[tuple]]:
    """All spans of all texts, with counts in plain dictionaries."""
    base = [plain_base(t) for t in texts]

    def free(i, start, end):
        for m in re.finditer(r"\w+", texts[i]):
            a, b = m.span()
            if a >= start and b <= end and not any(s < b and e > a for _, s, e in base[i]):
                yield m.group().lower(), a, b

    def entity(i, s):
        value = texts[i][s[1]:s[2]].lower()
        return s[0], value if s[0] in ("email", "ip") else re.sub("[^0-9]", "", value)
    n_c, n_t, n_ct, near = Counter(), Counter(), Counter(), []
    for i, text in enumerate(texts):
        n_c.update({entity(i, s) for s in base[i]})
        n_t.update({w.lower() for w in re.findall(r"\w+", text)})
        near.append({(entity(i, s), t) for s in base[i] for a, b in ((s[1] - S.NEAR, s[1]), (s[2], s[2] + S.NEAR))
                     for t, _, _ in free(i, a, b)})
        n_ct.update(near[i])
    n = len(texts)

    def disclosed(c, t):
        if n_ct[c, t] < support or n_c[c] == n:
            return False
        return math.log(n_ct[c, t] * n / (n_c[c] * n_t[t])) / math.log(n / n_c[c]) >= S.GENERALISE - 1e-9
    out = []
    for i, text in enumerate(texts):
        terms = {t for c, t in near[i] if disclosed(c, t)}
        out.append(sorted(base[i] + [("term", a, b) for t, a, b in free(i, 0, len(text)) if t in terms],
                          key=lambda s: (s[1], S.KINDS.index(s[0]))))
    return out


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def told(texts: list[str]) -> list[tuple]:
    rows = []
    for spans in plain_spans(texts):
        base = [s for s in spans if s[0] != "term"]
        rows.append((*[sum(s[0] == k for s in base) for k in PLAIN], hashlib.sha256(listed(base).encode()).hexdigest(),
                     listed(spans)))
    return rows


def test_query_equals_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op11_pii(spark, SF)
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = sorted((d.doc_id, *r) for d, r in zip(docs, told([d.text or "" for d in docs])))
    assert sorted(tuple(r)[:7] for r in got.collect()) == want


def some_docs():
    rng = random.Random(4)
    common = [f"word{k}" for k in range(60)]
    texts = [" ".join(rng.choices(common, k=30)) for _ in range(200)]
    texts += [f"{' '.join(rng.choices(common, k=5))} Ana Quill, surgeon at Northgate, ana.q@north.example.org. "
              f"{' '.join(rng.choices(common, k=20))} Quill said" for _ in range(6)]
    texts += ["a surgeon elsewhere " + " ".join(rng.choices(common, k=9)) for _ in range(40)]
    texts += ["call +49 (30) 1234567 Quill", "", "ana.q@north.example.org Ünïque " * 50, "10.0.0.1 host alpha"]
    return texts


def test_telling_terms_go(spark, odd_docs):
    texts = some_docs()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, spans string")
    got = {r.doc_id: tuple(r)[1:7] for r in S.report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == told(texts)
    clean = {r.doc_id: r.text for r in S.sanitised(docs).collect()}
    for i in range(200, 206):
        assert "north" not in clean[i].lower() and "Quill" not in clean[i] and "[email]" in clean[i]
        assert "word" in clean[i]
    assert "surgeon" in clean[200] and all(clean[i] == texts[i] for i in (*range(200), *range(206, 246)))


def test_hot_entity_and_odd_texts(spark, odd_docs, no_docs):
    hot = [(1000 + i, "write to help@desk.example.com now " + "ab"[i % 2] * (i % 7), "en", "s", 1, 1, 2, "c", "d") for i in range(90)]
    docs = odd_docs.union(spark.createDataFrame(hot, odd_docs.schema))
    rows = docs.collect()
    got = sorted(((r.doc_id or -1, *tuple(r)[1:7]) for r in S.report(docs).collect()))
    assert got == sorted((d.doc_id or -1, *r) for d, r in zip(rows, told([d.text or "" for d in rows])))
    assert S.sanitised(docs).columns == docs.columns and S.sanitised(docs).count() == len(rows)
    assert S.report(no_docs).count() == 0
