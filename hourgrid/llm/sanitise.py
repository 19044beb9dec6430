"""Sanitisation of personal data by information content: besides addresses and numbers, the terms that give them away.

Mail addresses, network addresses, card and phone numbers are found by their patterns; each distinct value is a protected entity.
Over the whole corpus, documents are counted that hold an entity c, a term t, and t close to c. A term discloses
``PMI(c; t) / IC(c)``, the share of the entity's information a reader learns from the term: 1 where t stands nowhere without c.
In a document that names c, terms near it whose disclosure reaches a threshold are generalised, or removed beyond a
second threshold, wherever they stand in that document (after Sanchez and Batet's C-sanitisation).
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import Bitmap, rows_mapped, stored, text_hash, to_batch

NEAR = 80  # characters on either side of an entity whose words are looked at
SUPPORT = 3  # documents that show a term near an entity, at least
GENERALISE, REMOVE = 0.9, 0.98  # disclosure from which a term is replaced by its class, or taken out
VOCABULARY = 1 << 20  # words a task knows before it hands its counts on
KINDS = ("email", "ip", "card", "phone", "term")
# The patterns. Runs are possessive, so a scan stays linear in the text.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"\w+")
DIGITS_ONLY = str.maketrans("", "", " -().+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, one try for each at sign: what stands before it, back to the last match, and the name behind it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        name = DOMAIN.match(text, at + 1) if start < at else None
        if name:
            last = name.end()
            yield start, last
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The pattern matches that pass their checks, by start and then kind."""
    found: list[Span] = [("email", *e) for e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m.group().translate(DIGITS_ONLY)
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(m.group().translate(DIGITS_ONLY).replace(".", "")) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def covered(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches of text that spans, sorted by start, cover; disjoint and in order."""
    out: list[tuple[int, int]] = []
    for _, start, end in spans:
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def free_words(text: str, start: int, end: int, cover: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """Whole words between ``start`` and ``end`` outside ``cover``, as (term, start, end)."""
    for m in WORD.finditer(text, start, end):
        a, b = m.span()
        if a == start > 0 and WORD.match(text[a - 1]) or b == end < len(text) and WORD.match(text[b]):
            continue  # cut by the edge
        at = bisect_left(cover, (b,))  # stretches before it begin before the word ends
        if not at or cover[at - 1][1] <= a:
            yield m.group().lower(), a, b


def entity_of(text: str, span: Span) -> int:
    """A hash of kind and value; letters' case and the spacing of numbers do not matter."""
    value = text[span[1]:span[2]].lower()
    value = value if span[0] in ("email", "ip") else value.translate(DIGITS_ONLY).replace(".", "")
    return xxhash.xxh64_intdigest(f"{span[0]}:{value}".encode()) - (1 << 63)


SPAN_SQL = "array<struct<kind string, start long, end long>>"
FOUND_SQL = f"doc_id long, key long, spans {SPAN_SQL}, entities array<long>, " \
            "near array<struct<entity long, term string>>, text string"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("spans", SPANS), ("entities", pa.list_(pa.int64())),
                   ("near", pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string())]))), ("text", pa.string())])


def _as_dicts(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def _scanned(_, doc_id, key, text: str) -> tuple:
    spans = base_spans(text)
    if not spans:
        return doc_id, key, [], [], [], None
    near, cover = set(), covered(spans)
    for span in spans:
        for a, b in ((max(0, span[1] - NEAR), span[1]), (span[2], min(len(text), span[2] + NEAR))):
            near |= {(entity_of(text, span), term) for term, _, _ in free_words(text, a, b, cover)}
    return (doc_id, key, _as_dicts(spans), sorted({entity_of(text, s) for s in spans}),
            [{"entity": e, "term": t} for e, t in sorted(near)], text)


class Terms(dict):
    """Word as written to the number of its term, the word in lower case."""

    def __init__(self, wanted: Bitmap):
        super().__init__()
        self.wanted, self.mask = wanted, int(wanted.mask)
        self.terms, self.numbers, self.count = [], {}, []

    def __missing__(self, word: str) -> int:
        term = word.lower()
        found = self.numbers.get(term)
        if found is None:  # a term no entity has near it needs no count: -1
            found = -1
            key = term_key(term) % (1 << 64)
            if int(self.wanted.words[(key & self.mask) >> 6]) >> (key & 63) & 1:
                found = len(self.terms)
                self.terms.append(term)
                self.count.append(0)
            self.numbers[term] = found
        self[word] = found
        return found


def term_key(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) - (1 << 63)


def _documents_with(wanted):
    """Counts of documents by term, for terms in the bitmap, complete for what a task held at a time."""
    schema = pa.schema([("term", pa.string()), ("n_t", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(wanted.value)

        def out() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(known.terms), 1 << 15):
                yield to_batch(list(zip(known.terms[k:k + (1 << 15)], known.count[k:k + (1 << 15)])), schema)
        for batch in batches:
            for text in batch.column(0):
                for number in set(map(known.__getitem__, WORD.findall(text.as_py()))):
                    if number >= 0:
                        known.count[number] += 1
                if len(known) > VOCABULARY:
                    yield from out()
                    known = Terms(wanted.value)
        yield from out()
    return run


def _keyed_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([term_key(t.as_py()) for t in batch.column(0)], pa.int64())], names=["key"])


def disclosures(found: DataFrame, texts: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE,
                remove: float = REMOVE) -> DataFrame:
    """``entity, term, n_ct, n_c, n_t, disclosure, action`` of the terms that disclose an entity too far.

    Documents are counted, copies included. ``found``: from ``scan``; ``texts``: (text), no nulls.
    """
    n = found.count()
    held = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    pairs = stored(found.select(F.explode("near").alias("near")).select("near.entity", "near.term")
                   .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= support), "pairs")
    wanted = Bitmap(pairs.select("term").distinct().mapInArrow(_keyed_terms, "key long"))
    seen = (texts.select("text").mapInArrow(_documents_with(texts.sparkSession.sparkContext.broadcast(wanted)),
                                            "term string, n_t long").groupBy("term").agg(F.sum("n_t").alias("n_t")))
    share = (F.log(F.col("n_ct")) + F.log(F.lit(max(n, 1))) - F.log("n_c") - F.log("n_t")) / F.nullif(
        F.log(F.lit(max(n, 1))) - F.log("n_c"), F.lit(0.0))
    return (pairs.join(held, "entity").join(seen, "term").withColumn("disclosure", share)
            .where(F.col("disclosure") >= generalise - 1e-9)
            .withColumn("action", F.when(F.col("disclosure") >= remove - 1e-9, "remove").otherwise("generalise")))


def _with_terms(_, doc_id, key, spans: list[dict], text: str | None, removed: list[str], general: list[str]) -> tuple:
    base = [(s["kind"], s["start"], s["end"]) for s in spans]
    out = [(*s, "generalise") for s in base]
    if removed or general:
        gone, replaced = set(removed), set(general)
        for term, a, b in free_words(text, 0, len(text), covered(base)):
            if term in gone or term in replaced:
                out.append(("term", a, b, "remove" if term in gone else "generalise"))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return doc_id, key, [{"kind": k, "start": s, "end": e, "action": x} for k, s, e, x in out]


def scan(docs: DataFrame) -> DataFrame:
    """Pattern matches, entities and the terms near them for each row of ``docs``; texts only where something was found."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_hash(docs).alias("key"),
                        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return stored(texts.mapInArrow(rows_mapped(FOUND, _scanned, ["doc_id", "key", "text"]), FOUND_SQL)
                  .withColumn("row", F.monotonically_increasing_id()), "scanned")


def spans(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``doc_id, key, spans`` for each row of ``docs``: kind, start, end (code points) and action of all that has to go.

    ``key`` is the hash of the text. Null texts are empty and have no spans, null ids and repeated rows stay; equal texts
    have equal spans. Terms never overlap pattern matches. An empty table gives no rows.
    """
    found = scan(docs)
    texts = docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    flagged = disclosures(found, texts, support, generalise, remove).select("entity", "term", "action")

    def terms(action: str):
        return F.collect_set(F.when(F.col("action") == action, F.col("term")))
    # By pairs that stand in the document itself, so the join grows with what was found near entities.
    own = (found.where(F.size("near") > 0).select("row", F.explode("near").alias("near"))
           .select("row", "near.entity", "near.term").join(flagged, ["entity", "term"])
           .groupBy("row").agg(terms("remove").alias("removed"), terms("generalise").alias("general")))
    both = found.select("row", "doc_id", "key", "spans", "text").join(own, "row", "left")
    none = F.array().cast("array<string>")
    both = both.select("doc_id", "key", "spans", "text", *[F.coalesce(c, none).alias(c) for c in ("removed", "general")])
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("spans", pa.list_(pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("action", pa.string())])))])
    return both.mapInArrow(rows_mapped(out, _with_terms, ["doc_id", "key", "spans", "text", "removed", "general"]),
                           "doc_id long, key long, spans array<struct<kind string, start long, end long, action string>>")


def rewritten(text: str, found: list[tuple]) -> str:
    """``text`` with each span (kind, start, end, action) replaced by its class in brackets, or taken out.

    Overlapping spans go as one, under the class of the first.
    """
    out, at = [], 0
    for kind, start, end, action in found:
        if start >= at:
            word = text[start:end]
            named = kind if kind != "term" else "number" if word.isdigit() else "name" if word[:1].isupper() else "term"
            out += [text[at:start], "" if action == "remove" else f"[{named}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``docs``, all columns, with texts rewritten by their ``spans``; rows without any stay as they are."""
    found = spans(docs) if found is None else found
    parts = [F.col(f"spans.{name}").alias(f"_{name}") for name in ("kind", "start", "end", "action")]
    use = (found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), *parts)
           .dropDuplicates(["_id", "_key"]))

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, kind: pd.Series, start: pd.Series, end: pd.Series, action: pd.Series) -> pd.Series:
        return pd.Series([rewritten(t, list(zip(*s))) for t, *s in zip(text, kind, start, end, action)])
    names = [F.col(f"_{name}") for name in ("kind", "start", "end", "action")]
    both = docs.join(use, (text_hash(docs) == use["_key"]) & docs["doc_id"].cast("long").eqNullSafe(use["_id"]), "left")
    empty = [F.coalesce(c, F.array().cast(t)) for c, t in zip(names, ("array<string>", "array<long>", "array<long>", "array<string>"))]
    return (both.withColumn("text", F.when(F.col("_key").isNull(), docs["text"])
                            .otherwise(rewrite(F.coalesce(docs["text"], F.lit("")), *empty))).select(*docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term`` from ``spans`` of each row."""
    found = spans(docs)
    base = F.filter("spans", lambda s: s["kind"] != "term")

    def listed(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                      s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"), count("term"))
