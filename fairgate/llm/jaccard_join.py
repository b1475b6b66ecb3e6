"""N-gram Jaccard join with token-combination prefixes, and its components.

A document is the set of its distinct word shingles (here: tokens, 48 bits of
a 64-bit hash, in hash order).  Documents with equal sets are one class.  Two
sets link when their Jaccard similarity is at least ``num / den`` = t.

Candidates.  Of a set x at most e = |x| - ceil(t |x|) tokens are missing from a
set it links with.  Every class contributes the first 2 (1 - t) |x| + 2 tokens
and some more (its window).  A token in at most ``rare`` windows is rare, any
other frequent; the counts cover all documents.

* A class whose window has more than e rare tokens is indexed by them alone:
  its prefix ends at the (e + 1)-th rare token, and a linked set whose prefix
  ends later holds one of them.
* Any other class has its prefix extended to 2 (1 - t) |x| + 2 tokens and is
  also indexed by the combinations of two frequent tokens that follow each
  other.  Its x - y and y - x tokens together spoil fewer combinations than
  the shared tokens form, so a linked set without a common rare token has a
  common combination.  Classes of the first kind answer with the combinations
  in their own prefixes.

Rare tokens give candidate pairs directly (a group has ``rare`` classes at
most).  A pair is dropped when the lengths or the number of shared rare tokens
rule the similarity out.  Combinations may be shared by any number of classes:
first every class is tried against one centre of its group and with its
smallest partner, so that a group of near copies costs as many trials as it
has members.  Only classes still in different components meet, in blocks
inside tasks, and only by parity sketches: a sketch has one bit for each
residue of the tokens, set when an odd number of tokens fall on it, so two
sketches differ in no more bits than the sets differ in tokens.  A pair whose
sketches differ in more bits than a link allows is refuted for certain and
never becomes a row.  A link counts only after verification on the whole
64-bit sets.

Defined cases: null or empty texts have size 0 and link with nothing; a text
of fewer words than a shingle is one token; rows are told apart by position,
so repeated ids and missing ids do no harm (a component's id is its smallest
non-null doc_id); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import components
from .idfilter import IdFilter
from .textutil import hash_strings, mix64, remove, small_batches, texts_of, unused, words_of, written

RARE = 8
SPARE = 16                 # tokens of a window beyond the extended prefix
TOKEN = np.uint64((1 << 48) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                               0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text (A-Z in
    lower case); fewer words than ``width`` are one shingle."""
    codes, offsets, words = words_of(pc.ascii_lower(texts))
    hashed = hash_strings(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    whole = np.zeros(max(len(hashed) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        whole += hashed[k:k + len(whole)] * _ODD[k % len(_ODD)]
    whole = mix64(whole)
    out = []
    for i, j in zip(offsets, offsets[1:]):
        if j - i >= width:
            out.append(np.unique(whole[i:j - width + 1]))
        elif j > i:
            few = np.array([len(_ODD) + j - i], dtype=np.uint64)
            for k in range(i, j):
                few = mix64(few * _ODD[0] + hashed[k])
            out.append(few)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _parity(s: np.ndarray) -> bytes:
    """The set's parity sketch, of about as many bits as it has tokens (256 to 2048)."""
    bits = 1 << min(max(len(s) - 1, 255).bit_length(), 11)
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _pack(x: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers: equal high bytes lie side by side and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(value: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(value, np.uint8).reshape(8, -1).T).view("<u8").ravel()


class _Rule:
    """Bounds that follow from a similarity of num / den."""

    def __init__(self, num: int, den: int):
        if not den <= 2 * num <= 2 * den:
            raise ValueError("the similarity must lie between one half and one")
        self.num, self.den = num, den

    def spare(self, n):                      # tokens of a set that a linked set may lack
        return n - (self.num * n + self.den - 1) // self.den

    def prefix(self, n):                     # the extended prefix
        return 2 * (self.den - self.num) * n // self.den + 2

    def window(self, n):
        return self.prefix(n) + SPARE

    def overlap(self, a, b):                 # shared tokens that a link needs
        return (self.num * (a + b) + self.num + self.den - 1) // (self.num + self.den)


def _sql(rule: _Rule) -> dict[str, str]:
    """The same bounds as SQL on a size column {n}."""
    return {"spare": f"({{n}} - ({rule.num} * {{n}} + {rule.den - 1}) div {rule.den})",
            "prefix": f"({2 * (rule.den - rule.num)} * {{n}} div {rule.den} + 2)",
            "overlap": f"(({rule.num} * ({{a}} + {{b}}) + {rule.num + rule.den - 1}) div {rule.num + rule.den})"}


def _whole(text: Column) -> Column:
    """Digest of the whole text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signatures(docs: DataFrame, width: int, rule: _Rule, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """rid (unique row), doc_id, n_shingles, sig (digest of the set), its
    parity sketch and the window's tokens; written once.  ``whole`` adds the digest of the text."""
    src = texts_of(docs, id_col, text_col)
    if whole:
        src = src.withColumn("whole", _whole(F.col("text")))
    more = ["whole"] if whole else []

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in small_batches(batches, limit=4 << 20):
            sets = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + len(sets))), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_digest(s) for s in sets], pa.binary()), pa.array([_parity(s) for s in sets], pa.binary()),
                 pa.array([_pack(s[:rule.window(len(s))] >> np.uint64(16)) for s in sets], pa.binary()),
                 *[batch.column(c) for c in more]], ["rid", "doc_id", "n_shingles", "sig", "parity", "window", *more])
            rid += len(sets)

    id_type = src.schema["doc_id"].dataType.simpleString()
    rows = src.mapInArrow(apply, f"rid bigint, doc_id {id_type}, n_shingles bigint, sig binary, parity binary, window binary" + ", whole binary" * whole)
    return written(rows, "shingles", compression="lz4")


def token_candidates(windows: DataFrame, rule: _Rule, rare: int = RARE) -> DataFrame:
    """From (cls, n_shingles, window): rows of two kinds.  ``pair``: classes a <
    b of sizes sa, sb that share n rare tokens of one part.  ``token``: class
    a of size sa has the frequent token b at place sb of its window.

    Tokens are dealt to parts by hash.  A token that one batch alone proves
    frequent is not gathered anywhere: its rows stay spread, and its part gets
    one mark."""
    spark = windows.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "window", 4 << 20):
            windows_ = [_unpack(w) for w in batch.column("window").to_pylist()]
            count = np.array([len(w) for w in windows_])
            token = np.concatenate(windows_)
            row = np.repeat(np.arange(len(windows_)), count)
            cls = batch.column("cls").to_numpy()[row]
            size = batch.column("n_shingles").to_numpy()[row]
            place = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
            part = (mix64(token) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((token, part))
            token, cls, size, place, part = (x[order] for x in (token, cls, size, place, part))
            first = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
            of = np.cumsum(first) - 1
            hot = np.bincount(of, minlength=1)[of] > rare if len(token) else first
            out = []
            if hot.any():
                spread = int(cls[0] % parts)
                out.append((-1 - spread, token[hot], cls[hot], size[hot], place[hot]))
                # the mark of a proven token: a class of none
                mark = hot & first
                token, cls, size, place, part = (np.concatenate([x[~hot], y]) for x, y in (
                    (token, token[mark]), (cls, np.full(mark.sum(), -1)), (size, size[mark]), (place, place[mark]), (part, part[mark])))
                order = np.argsort(part, kind="stable")
                token, cls, size, place, part = (x[order] for x in (token, cls, size, place, part))
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            out += [(int(part[i]), token[i:j], cls[i:j], size[i:j], place[i:j]) for i, j in zip(at, [*at[1:], len(part)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), *[pa.array([_pack(o[k]) for o in out], pa.binary()) for k in range(1, 5)]],
                ["part", "token", "cls", "size", "place"])

    def rows(kind: int, a, sa, b, sb, n) -> pa.Table:
        return pa.table({"kind": pa.array(np.full(len(a), kind), pa.int32()), **{k: pa.array(np.asarray(v, dtype=np.int64)) for k, v in (
            ("a", a), ("sa", sa), ("b", b), ("sb", sb), ("n", n))}})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        token, cls, size, place = (np.concatenate([_unpack(v) for v in table.column(c).to_pylist()]).astype(np.int64)
                                   for c in ("token", "cls", "size", "place"))
        if key[0].as_py() < 0:
            return rows(1, cls, size, token, place, np.zeros(len(cls)))
        order = np.lexsort((cls, token))
        token, cls, size, place = (x[order] for x in (token, cls, size, place))
        first = np.concatenate([[True], token[1:] != token[:-1]])
        of = np.cumsum(first) - 1
        n = np.bincount(of)
        frequent = (n > rare) | (np.bincount(of, weights=cls < 0) > 0)
        some = frequent[of] & (cls >= 0)
        out = [rows(1, cls[some], size[some], token[some], place[some], np.zeros(some.sum()))]
        starts = np.flatnonzero(first)
        a, b = [], []
        for k in range(2, rare + 1):
            at = starts[(n == k) & ~frequent]
            if len(at):
                i, j = np.triu_indices(k, 1)
                a.append((at[:, None] + i).ravel())
                b.append((at[:, None] + j).ravel())
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            near = rule.den * np.minimum(size[a], size[b]) >= rule.num * np.maximum(size[a], size[b])
            a, b = a[near], b[near]
            order = np.lexsort((cls[b], cls[a]))
            a, b = a[order], b[order]
            if len(a):
                new = np.concatenate([[True], (cls[a[1:]] != cls[a[:-1]]) | (cls[b[1:]] != cls[b[:-1]])])
                times = np.diff(np.append(np.flatnonzero(new), len(a)))
                a, b = a[new], b[new]
                out.append(rows(0, cls[a], size[a], cls[b], size[b], times))
        return pa.concat_tables(out)

    dealt = windows.select("cls", "n_shingles", "window").mapInArrow(
        deal, "part int, token binary, cls binary, size binary, place binary")
    return written(dealt.groupBy("part").applyInArrow(merge, "kind int, a bigint, sa bigint, b bigint, sb bigint, n bigint"),
                   "candidates")


def _pairs(candidates: DataFrame, modes: DataFrame, rule: _Rule) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of rare tokens that the number of shared ones allows
    (pairs with a class of the second kind need one only), and the written
    table they are read from."""
    sql = _sql(rule)
    total = (candidates.where("kind = 0").groupBy("a", "b", "sa", "sb").agg(F.sum("n").alias("n")))
    need = F.expr("least({o} - sa + {ea} + 1, {o} - sb + {eb} + 1)".format(
        o=sql["overlap"].format(a="sa", b="sb"), ea=sql["spare"].format(n="sa"), eb=sql["spare"].format(n="sb")))
    total = written(total.withColumn("enough", F.col("n") >= need), "rare-pairs", compression="lz4")
    extended = modes.where("extended").select("cls")
    short = total.where("not enough")
    rest = (short.join(extended.withColumnRenamed("cls", "a"), "a", "left_semi")
            .unionByName(short.join(extended.withColumnRenamed("cls", "b"), "b", "left_semi").select(short.columns)))
    return total.where("enough").unionByName(rest).select("a", "b").distinct(), total


def _combinations(candidates: DataFrame, rule: _Rule) -> tuple[DataFrame, DataFrame]:
    """Per class with frequent tokens: whether its prefix is extended; and the
    groups' rows (t1, t2, cls, size, extended) that a class of that kind shares."""
    sql = _sql(rule)
    spare, prefix = sql["spare"].format(n="size"), sql["prefix"].format(n="size")
    per = (candidates.where("kind = 1").groupBy(F.col("a").alias("cls"), F.col("sa").alias("size"))
           .agg(F.sort_array(F.collect_list(F.struct(F.col("sb").alias("place"), F.col("b").alias("token")))).alias("has"))
           # rare tokens of the window against the spare ones
           .withColumn("extended", F.expr(f"least(size, {prefix} + {SPARE}) - size(has) <= {spare}"))
           .withColumn("has", F.expr(f"filter(has, (x, i) -> if(extended, x.place < {prefix}, x.place - i <= {spare}))")))
    per = materialize(per)
    combos = (per.where("size(has) > 1")
              .select("cls", "size", "extended", F.expr("explode(transform(sequence(1, size(has) - 1), "
                                                        "i -> struct(has[i - 1].token as t1, has[i].token as t2))) as c"))
              .select("c.t1", "c.t2", "cls", "size", "extended"))
    groups = (combos.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.max("extended").alias("any"))
              .where("n > 1 and any").select("t1", "t2"))
    return per.select("cls", "extended"), materialize(combos.join(groups, ["t1", "t2"]))


def _near(a: Column, b: Column, rule: _Rule) -> Column:
    return F.least(a, b) * rule.den >= F.greatest(a, b) * rule.num


_LEVELS = (256, 512, 1024, 2048)
_AT_ONCE = 1 << 17          # pairs of sketches compared at once


class _Sketches:
    """Parity sketches folded to every length up to their own."""

    def __init__(self, parity: list[bytes]):
        self.level = np.array([_LEVELS.index(8 * len(p)) for p in parity])
        self.bits = []
        for k, bits in enumerate(_LEVELS):
            rows = np.zeros((len(parity), bits // 8), dtype=np.uint8)
            for top in range(k, len(_LEVELS)):
                at = np.flatnonzero(self.level == top)
                if len(at):
                    whole = np.frombuffer(b"".join(parity[i] for i in at), np.uint8).reshape(len(at), -1, bits // 8)
                    rows[at] = np.bitwise_xor.reduce(whole, axis=1)
            self.bits.append(rows.view(np.uint64))

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A lower bound of the number of tokens in one of two sets only."""
        level, out = np.minimum(self.level[a], self.level[b]), np.zeros(len(a), dtype=np.int64)
        for k, rows in enumerate(self.bits):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.bitwise_count(rows[a[at]] ^ rows[b[at]]).sum(axis=1)
        return out


def _meetings(first: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare, in bounded portions: all pairs of rows in each
    group (groups begin where ``first``), across its two blocks if it has two."""
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(first)))
    for k in np.unique(n[(n > 1) & (n <= 32)]):
        i, j = np.triu_indices(int(k), 1)
        at = starts[n == k]
        step = max(1, _AT_ONCE // len(i))
        for s in range(0, len(at), step):
            a, b = (at[s:s + step, None] + i).ravel(), (at[s:s + step, None] + j).ravel()
            cross = (low[a] == high[a]) | (own[a] != own[b])
            yield a[cross], b[cross]
    for s, m in zip(starts[n > 32], n[n > 32]):
        step = max(1, _AT_ONCE // int(m))
        for i in range(int(s), int(s + m), step):
            rows = np.arange(i, min(i + step, int(s + m)))
            a, b = np.repeat(rows, s + m - rows - 1), np.concatenate([np.arange(r + 1, s + m) for r in rows])
            cross = (low[a] == high[a]) | (own[a] != own[b])
            yield a[cross], b[cross]


def _one_each(pairs: np.ndarray, salt: int) -> np.ndarray:
    """Of the pairs of each class only one: with the smallest partner (salt
    0), or with one that depends on the salt alone."""
    if not len(pairs):
        return pairs
    cls = np.concatenate([pairs[:, 0], pairs[:, 1]])
    partner = np.concatenate([pairs[:, 1], pairs[:, 0]])
    rank = mix64(partner.astype(np.uint64) ^ mix64(cls.astype(np.uint64) + np.uint64(salt))) if salt else partner
    order = np.lexsort((rank, cls))
    first = order[np.concatenate([[True], cls[order][1:] != cls[order][:-1]])]
    return np.unique(pairs[first % len(pairs)], axis=0)


def _unrefuted(members: DataFrame, rule: _Rule, salt: int | None = None, block: int = 4096, bucket_rows: int = 20_000) -> DataFrame:
    """Pairs a < b of classes of one combination (rows t1, t2, n (rows of the
    combination), cls, size, extended, comp, parity) in different components
    that neither lengths nor sketches refute; with a ``salt``, one pair a
    class and task only.  A combination of very many classes is cut into
    blocks, and every two blocks meet in a group of their own."""
    dealt = (members.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")))
    buckets = max(1, members.count() // bucket_rows)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("t1", "t2", "low", "high"), F.lit(buckets)).cast("int"))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        names = ["t1", "t2", "low", "high", "own", "cls", "size", "comp", "extended"]
        column = {c: table.column(c).to_numpy() for c in names}
        order = np.lexsort([column[c] for c in ("cls", "high", "low", "t2", "t1")])
        t1, t2, low, high, own, cls, size, comp, extended = (column[c][order] for c in names)
        sketch = _Sketches(table.column("parity").take(pa.array(order)).to_pylist())
        first = np.concatenate([[True], (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        found = [np.zeros((0, 2), dtype=np.int64)]
        for a, b in _meetings(first, own, low, high):
            near = ((comp[a] != comp[b]) & (extended[a] | extended[b])
                    & (rule.den * np.minimum(size[a], size[b]) >= rule.num * np.maximum(size[a], size[b])))
            a, b = a[near], b[near]
            allowed = size[a] + size[b] - 2 * rule.overlap(size[a], size[b])
            near = sketch.differ(a, b) <= allowed
            some = np.unique(np.stack([np.minimum(cls[a], cls[b])[near], np.maximum(cls[a], cls[b])[near]], axis=1), axis=0)
            found.append(some if salt is None else _one_each(some, salt))
        pairs = np.unique(np.concatenate(found), axis=0)
        pairs = pairs if salt is None else _one_each(pairs, salt)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.drop("other", "blocks", "n").groupBy("bucket").applyInArrow(meet, "a bigint, b bigint").distinct()


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, tokens) of the wanted classes: the whole sets, made anew from the
    documents that a fixed-size id filter lets through."""
    named = materialize(wanted.join(classes, "cls").select("cls", "doc_id", "sig"))
    among = IdFilter.of(named, "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(among.select(batches, "doc_id"), limit=2 << 20):
            sets = shingle_sets(batch.column("text"), width)
            tokens = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(s) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32), pa.array(tokens))], ["sig", "tokens"])

    found = texts_of(docs, id_col, text_col).mapInArrow(make, "sig binary, tokens array<bigint>")
    return written(found.join(named.select("cls", "sig"), "sig").dropDuplicates(["sig"]).select("cls", "tokens"), "sets", compression="lz4")


def _verified(pairs: DataFrame, sets: DataFrame, rule: _Rule, n_sets: int, block: int = 1024) -> DataFrame:
    """The pairs (a, b) that link, as (u, v).  Classes are dealt to blocks of
    about ``block``; the pairs of two blocks are verified together, so a set
    travels once for every block that it is tried with, not once a pair."""
    blocks = F.lit(max(1, n_sets // block))
    of = lambda c: F.pmod(F.xxhash64(c), blocks).cast("int")
    dealt = pairs.select(of("a").alias("i"), of("b").alias("j"), "a", "b")
    side = lambda c: dealt.select(F.col("i").alias("si"), F.col("j").alias("sj"), F.col(c).alias("cls"))
    held = side("a").unionByName(side("b")).distinct().join(sets, "cls").select("si", "sj", "cls", "tokens")

    def check(key: tuple, tried: pa.Table, held: pa.Table) -> pa.Table:
        tokens = held.column("tokens").combine_chunks()
        offsets, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        cls = held.column("cls").to_numpy()
        order = np.argsort(cls)
        at = lambda name: order[np.searchsorted(cls, tried.column(name).to_numpy(), sorter=order)]
        ok = []
        for x, y in zip(at("a"), at("b")):
            p, q = flat[offsets[x]:offsets[x + 1]], flat[offsets[y]:offsets[y + 1]]
            both = np.concatenate([p, q])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            ok.append(rule.den * shared >= rule.num * (len(both) - shared))
        keep = pa.array(ok, pa.bool_())
        return pa.table({"u": tried.column("a").filter(keep), "v": tried.column("b").filter(keep)})

    return materialize(dealt.groupBy("i", "j").cogroup(held.groupBy("si", "sj")).applyInArrow(check, "u bigint, v bigint"))


def _resolve(pairs: DataFrame, links: DataFrame | None, sets: DataFrame, rule: _Rule, stars: int) -> tuple[DataFrame, DataFrame]:
    """``links`` and what the pairs add to its components, and the components.
    In each of the first rounds every class is tried with its smallest partner
    only; the pairs still between two components are all tried at the end."""
    rest, n_sets, label = pairs, sets.count(), None
    for star in [True] * stars + [False]:
        picked = materialize(rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if star else rest)
        good = _verified(picked, sets, rule, n_sets)
        links = good if links is None else links.unionByName(good)
        label = components(links)
        if star:
            side = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: E731, B023
            rest = (rest.join(picked, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
                    .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))
            rest = materialize(rest)
            if rest.isEmpty():
                break
        # one link a class says as much as all of them
        links = label.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    return label.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")), label


def jaccard_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, rare: int = RARE, stars: int = 1,
                       id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """rid, doc_id, n_shingles, component (unique), component_id (its smallest doc_id) of every row;
    ``whole`` adds the digest of its text."""
    rule = _Rule(num, den)
    rows = signatures(docs, width, rule, id_col, text_col, whole)
    more = ["whole"] if whole else []
    # a set held by very many documents is one row per task before the shuffle
    best = (rows.where("n_shingles > 0").groupBy("sig")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "rid", "doc_id")).alias("m")))
    classes = materialize(best.select("sig", F.col("m.rid").alias("cls"), F.col("m.doc_id").alias("doc_id")))
    windows = rows.join(classes.select(F.col("cls").alias("rid")), "rid", "left_semi").withColumnRenamed("rid", "cls")
    candidates = token_candidates(windows, rule, rare)
    # the windows, by far the largest part of the rows, have served
    wide, rows = rows, written(rows.drop("window"), "rows")
    remove(docs.sparkSession, wide)
    modes, combos = _combinations(candidates, rule)

    centre = combos.groupBy("t1", "t2").agg(F.min(F.struct("cls", "size")).alias("c"))
    star = (combos.join(centre, ["t1", "t2"]).where("cls <> c.cls").where(_near(F.col("size"), F.col("c.size"), rule))
            .select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")))
    # one trial for each class here; what it leaves apart meets below
    star = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    of_rare, total = _pairs(candidates, modes, rule)
    tried = materialize(of_rare.unionByName(star).distinct())
    remove(docs.sparkSession, candidates, total)
    wanted = (tried.select(F.col("a").alias("cls")).distinct().unionByName(tried.select(F.col("b").alias("cls")).distinct())
              .unionByName(combos.select("cls").distinct()).distinct())
    sets = _sets(wanted, classes, docs, width, id_col, text_col)
    links, label = _resolve(tried, None, sets, rule, stars)
    # Classes of a combination that are still apart meet member by member.
    # Nearly all pairs that the sketches leave are links, so one pair a class
    # joins most of them; the last round tries every pair still between two
    # components.
    parity = rows.select(F.col("rid").alias("cls"), "parity")
    for salt in (0, None):
        open_ = (combos.join(label, combos["cls"] == label["node"], "left")
                 .select("t1", "t2", "cls", "size", "extended", F.coalesce("component", "cls").alias("comp")))
        split = open_.groupBy("t1", "t2").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("t1", "t2", "n")
        open_ = written(open_.join(split, ["t1", "t2"]).join(parity, "cls"), "open", compression="lz4")
        fresh = materialize(_unrefuted(open_, rule, salt).join(tried, ["a", "b"], "left_anti"))
        remove(docs.sparkSession, open_)
        if not fresh.isEmpty():
            links, label = _resolve(fresh, links, sets, rule, 0)
            tried = tried.unionByName(fresh)
    remove(docs.sparkSession, sets)
    member = (rows.select("rid", "doc_id", "n_shingles", "sig", *more).join(classes.select("sig", "cls"), "sig", "left")
              .join(label.withColumnRenamed("node", "cls"), "cls", "left")
              .select("rid", "doc_id", "n_shingles", F.coalesce("component", "cls", "rid").alias("component"), *more))
    member = materialize(member)
    least = materialize(member.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return member.join(least, "component").select("rid", "doc_id", "n_shingles", "component", "component_id", *more)


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` (all columns) without near copies: of each
    component one row stays, of the smallest doc_id (of those without one if
    none has); texts without words all stay.  A row is known by its doc_id and
    the digest of its whole text; rows equal in both are one component."""
    found = jaccard_components(docs, width, num, den, whole=True).where("n_shingles > 0")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "whole")).alias("f"))
    own, of_id, of_whole = unused(docs.columns, "own_whole", "of_id", "of_whole")
    stays = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("whole") == F.col("f.whole"))
    marks = materialize(found.join(materialize(first), "component").groupBy(F.col("doc_id").alias(of_id), F.col("whole").alias(of_whole))
                        .agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(own) == F.col(of_whole))
    left = docs.withColumn(own, _whole(F.col("text"))).join(marks.where("not stays").select(of_id, of_whole), same, "left_anti")
    # rows that share the first one's doc_id and text: any one of them
    again = marks.where("stays").select(of_id, of_whole)
    if not again.isEmpty():
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", own]))
    return left.drop(own)
