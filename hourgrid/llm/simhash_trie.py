"""SimHash near-duplicates: 64-bit fingerprints joined with themselves through a binary trie with an error budget.

Two fingerprints that differ in at most ``budget`` bits agree on one of ``budget + 1`` blocks of bits. Each block is put
in turn at the top of the trie and its value deals the fingerprints out to tasks; below it, a task walks pairs of trie
nodes, adds up the bits their prefixes differ in, and leaves a pair as soon as the sum exceeds the budget. A pair of
nodes whose leaves are all linked already is left too, so a dense group costs about its size and not its square.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import rows_mapped, stored, text_hash, texts_of, to_batch
from hourgrid.llm.components import components

BITS = 64
SHINGLE = 4
BUDGET = 4
PAGE = 128
CROWD = 200_000
CHUNK = 1 << 16
SEED = 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text; 0 if it has no word.

    Words are what ASCII white space separates after A-Z became lower case; every run of ``shingle`` words counts, a
    shorter text counts as one run. A bit is 1 if more than half of the runs' XXH64 values have it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    flat = b" ".join(words)
    if len(words) <= shingle:
        return digest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = len(words) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, CHUNK):
        upto = min(total, at + CHUNK)
        spans = zip(starts[at:upto].tolist(), ends[at + shingle - 1:upto + shingle - 1].tolist())
        hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in spans), np.uint64, upto - at)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; ``fp`` is the fingerprint's 64 bits as a signed long."""
    return _marks(texts_of(docs), shingle, ["doc_id"])


def _marks(texts: DataFrame, shingle: int, names: list[str]) -> DataFrame:
    """The columns ``names`` (long) of ``texts`` and the fingerprint of each row's text as fp."""
    def one(_, text, *values):
        value = fingerprint(text, shingle)
        return *values, value - (1 << 64) if value >> 63 else value
    schema = pa.schema([(n, pa.int64()) for n in [*names, "fp"]])
    return texts.mapInArrow(rows_mapped(schema, one, ["text", *names]), ", ".join(f"{n} long" for n in [*names, "fp"]))


def blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, number of bits) of ``budget + 1`` blocks of nearly equal length."""
    cuts = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _prefix_bits(x: np.ndarray, lo: int, hi: int) -> int:
    """How many leading bits all leaves of a node share."""
    return BITS - int(x[lo] ^ x[hi - 1]).bit_length()


def linked(values: np.ndarray, budget: int = BUDGET, page: int = PAGE) -> np.ndarray:
    """For distinct ascending uint64 ``values``: the position of each one's set leader, linking at ``budget`` bits.

    Sets are exactly the connected components of the links among these values.
    """
    n = len(values)
    parent = list(range(n))
    solid: set[tuple[int, int]] = set()

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def split(lo: int, hi: int) -> int:
        shift = np.uint64(BITS - 1 - _prefix_bits(values, lo, hi))
        middle = ((values[lo] >> shift) | np.uint64(1)) << shift
        return lo + int(np.searchsorted(values[lo:hi], middle))

    def is_solid(lo: int, hi: int) -> bool:
        if (lo, hi) in solid:
            return True
        if hi - lo <= page:
            root = find(lo)
            whole = all(find(i) == root for i in range(lo + 1, hi))
        else:
            m = split(lo, hi)
            whole = (lo, m) in solid and (m, hi) in solid and find(lo) == find(m)
        if whole:
            solid.add((lo, hi))
        return whole

    stack = [(0, n, 0, n)]
    while stack:
        a, a_end, b, b_end = stack.pop()
        same = a == b and a_end == b_end
        if not same:
            shared = min(_prefix_bits(values, a, a_end), _prefix_bits(values, b, b_end))
            if shared and int(values[a] ^ values[b]) >> (BITS - shared) != 0 and \
                    (int(values[a] ^ values[b]) >> (BITS - shared)).bit_count() > budget:
                continue
            if is_solid(a, a_end) and is_solid(b, b_end) and find(a) == find(b):
                continue
        elif a_end - a < 2 or is_solid(a, a_end):
            continue
        wide_a, wide_b = a_end - a > page, b_end - b > page
        if not wide_a and not wide_b:
            near = np.bitwise_count(values[a:a_end, None] ^ values[None, b:b_end]) <= budget
            left, right = np.nonzero(np.triu(near, 1) if same else near)
            if len(left):
                roots_a = np.array([find(i) for i in range(a, a_end)])
                roots_b = roots_a if same else np.array([find(i) for i in range(b, b_end)])
                for p in np.unique(roots_a[left] * n + roots_b[right]).tolist():
                    p, q = find(p // n), find(p % n)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        elif same:
            m = split(a, a_end)
            stack += [(a, m, m, a_end), (m, a_end, m, a_end), (a, m, a, m)]
        elif a_end - a >= b_end - b:
            m = split(a, a_end)
            stack += [(a, m, b, b_end), (m, a_end, b, b_end)]
        else:
            m = split(b, b_end)
            stack += [(a, a_end, b, m), (a, a_end, m, b_end)]
    return np.array([find(i) for i in range(n)])


def _joined(budget: int):
    """For ``mapInArrow`` over rows sorted by key: links that hold each key's sets together."""
    def links(x: np.ndarray) -> Iterator[tuple[int, int]]:
        x = np.unique(x)
        if len(x) > 1:
            leader = linked(x, budget)
            others = np.nonzero(leader != np.arange(len(x)))[0]
            yield from zip(x[others].view(np.int64).tolist(), x[leader[others]].view(np.int64).tolist())

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.nonzero(parts[1:] != parts[:-1])[0] + 1).tolist(), len(parts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if parts[lo] != key:
                    if held:
                        found += links(np.concatenate(held))
                    key, held = parts[lo], []
                held.append(fps[lo:hi])
                if len(found) > 100_000:
                    yield to_batch(found, schema)
                    found = []
        if held:
            found += links(np.concatenate(held))
        if found:
            yield to_batch(found, schema)
    return run


def trie_edges(values: DataFrame, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """``values`` (fp): distinct fingerprints. Links (u, v) whose components are those of all pairs within ``budget``.

    A block value that more than ``crowd`` fingerprints share is walked further down in Spark before it is dealt out: by
    the next bits, each fingerprint goes to the pairs of nodes whose prefixes are within the budget, so no task has to
    hold a crowded block.
    """
    top = blocks(budget)
    entries = values.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"),
                 F.shiftrightunsigned(F.shiftleft("fp", start), BITS - length).alias("value"),
                 F.shiftrightunsigned(F.shiftleft("fp", (start + length) % BITS), BITS - 8).alias("below"))
        for i, (start, length) in enumerate(top)])).alias("e")).select("fp", "e.*")
    entries = entries.withColumn("key", F.col("block") * F.lit(1 << 16) + F.col("value")).drop("block", "value")
    crowded = (entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
               .select("key", F.least(F.lit(8), F.ceil(F.log2(F.col("n") / crowd))).cast("int").alias("down")))
    placed = entries.join(crowded, "key", "left").withColumn("down", F.coalesce("down", F.lit(0)))
    node = placed.withColumn("node", F.expr("cast(shiftrightunsigned(below, 8 - down) as int)"))
    tasks = F.expr(f"""transform(filter(sequence(0, shiftleft(1, down) - 1), m -> bit_count(m ^ node) <= {int(budget)}),
                                 m -> cast(key * 65536 + least(m, node) * 256 + greatest(m, node) as long))""")
    dealt = node.select(F.explode(tasks).alias("task"), "fp")
    return (dealt.repartition("task").sortWithinPartitions("task")
            .mapInArrow(_joined(budget), "u long, v long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id): a component is what links of at most ``budget`` differing bits reach.

    ``component_id`` is the smallest ``doc_id`` reached, the document's own included. Null and empty texts and texts
    without a word have fingerprint zero and link like any other. Repeated rows are all returned; a null ``doc_id`` is
    returned as null and never names a component that has another id. An empty table gives no rows. Equal fingerprints
    are linked by grouping alone, so copies are never expanded into pairs.
    """
    named = _named(stored(fingerprints(docs, shingle), "fingerprints"), budget, crowd)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(marks: DataFrame, budget: int, crowd: int = CROWD) -> DataFrame:
    """``marks`` (doc_id, fp and more) with the component_id of each row."""
    distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    found = components(trie_edges(distinct.select("fp"), budget, crowd))
    of = (distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
          .select("fp", "first_id", F.coalesce("component", "fp").alias("component")))
    names = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = of.join(names, "component").select("fp", "component_id")
    return marks.join(named, "fp")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` that stand for their component: those whose doc_id is its smallest.

    A component in which no row has an id keeps its rows without one; rows repeated under the kept id stay, as one
    document. Rows that share a doc_id are judged each by its own text.
    """
    texts = texts_of(docs).withColumn("of", F.xxhash64("text"))
    found = _named(stored(_marks(texts, shingle, ["doc_id", "of"]), "fingerprints"), budget)
    gone = found.where("doc_id != component_id or doc_id is null and component_id is not null")
    gone = stored(gone.select(F.col("doc_id").alias("_gone"), F.col("of").alias("_of")).distinct(), "near-copies")
    own = docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (text_hash(docs) == gone["_of"])
    return docs.join(gone, own, "left_anti")
