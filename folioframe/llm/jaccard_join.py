"""Operator 6, n-gram Jaccard join: MinHash banding, then exact verification on whole n-gram sets.

Texts become sets of ``n``-word shingles (64-bit names). Documents with equal sets are one *set* from
then on, with a number of copies. Bands and rows are chosen for the wanted recall at the threshold.
Candidates are the sets that share a band hash (a bucket). No group is formed before verification:

1. every member of a bucket is compared with the bucket's least set; links that hold at the threshold
   connect *groups*, so a group is part of a class of linked sets;
2. all pairs inside a group are compared, which also finds links that banding misses;
3. buckets that hold sets of several groups are compared too, but only pairs of different groups, each
   in the first band that it shares, so that no link is lost or counted twice.

Work is cut into blocks of bounded size, and each pair of blocks is one unit, which returns a number
of links for each set and a spanning forest, never the pairs. Only sets of buckets are shuffled.

Words are maximal runs outside white space, unchanged. Texts under ``n`` words have one shingle of all
their words; texts without words (null, empty) have no links. Copies, repeated rows included, are
similar to each other. An id of null is kept and never names a class that has another id. Ids may have
any type; other columns are not read, so their names cannot clash. One text's set is held at a time by
the worker that reads it; it may be as long as a text. No table, an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, binary_parts, chunks, keyed, materialize, mix, sliced, table
from .components import components
from .recompression import RangeNames, word_names, words

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Hash functions a text may take: the more, the more rows a band can have, and the fewer unlike pairs it lets through.
HASHES = 144
#: Bounds of a block: sets, and shingles of all its sets (but one set is never cut).
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20


def choose_bands(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: as many rows as ``hashes`` allow while a pair at the threshold shares a band with probability ``recall``."""
    best = None
    for rows in range(1, hashes + 1):
        hit = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows > hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"{hashes} hash functions cannot reach a recall of {recall} at {threshold}")
    return best


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle names of each text of a batch; every text ends with a line break."""
    out: list[np.ndarray] = []
    for first, last in chunks(offsets, 1 << 18):
        part = data[offsets[first] : offsets[last]]
        begin, end = words(part)
        at = np.searchsorted(begin, offsets[first : last + 1] - offsets[first])
        names = word_names(part, begin, end)
        spans = RangeNames(names)
        every = spans(np.arange(len(names) - n + 1), np.arange(n, len(names) + 1)) if len(names) >= n else names[:0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(every[a : b - n + 1]))
            elif b > a:
                out.append(spans(np.array([a]), np.array([b])))
            else:
                out.append(names[:0])
    return out


def _salts(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=U64), np.full(k, 5, U64), 31) | U64(1)


def signatures(sets: list[np.ndarray], salts: np.ndarray) -> np.ndarray:
    """MinHash values of sets that are not empty: least salted products of their shingles, sets by salts."""
    out = np.empty((len(sets), len(salts)), U64)
    offsets = np.cumsum([0] + [len(s) for s in sets])
    for a, b in chunks(offsets, 1 << 15):
        x = np.concatenate(sets[a:b])
        x ^= x >> U64(31)
        starts = offsets[a:b] - offsets[a]
        for k, s in enumerate(salts):
            out[a:b, k] = np.minimum.reduceat(x * s, starts)
    return out


def set_name(s: np.ndarray) -> bytes:
    """128-bit name of a set of shingles."""
    x = mix(s, s >> U64(7), 41)
    return np.array([x.sum(dtype=U64), np.bitwise_xor.reduce(mix(x, s, 42)) + U64(len(s))], ">u8").tobytes()


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("_t", F.concat("_t", F.lit("\n")).cast("binary"))


def _signed(rows: DataFrame, n: int, bands: int, per: int) -> DataFrame:
    """_d, _h, sid (name of the shingle set, null if empty), size, bands (array of hashes that differ by band)."""
    import pyarrow as pa

    def emit(batches: Iterator) -> Iterator:
        salts = _salts(bands * per)
        place = np.arange(bands, dtype=U64)
        for batch in sliced(batches):
            sets = shingle_sets(*binary_parts(batch.column("_t")), n)
            full = [s for s in sets if len(s)]
            low = signatures(full, salts).reshape(len(full), bands, per)
            name = mix(low[:, :, 0], np.broadcast_to(place, low.shape[:2]), 44)
            for k in range(1, per):
                name = mix(name, low[:, :, k], 43)
            some = np.array([len(s) > 0 for s in sets], bool)
            offsets = np.append(0, np.cumsum(some)).astype(np.int32) * bands
            hashes = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(name.ravel().view(np.int64)))
            sid = [set_name(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_d"), batch.column("_h"), pa.array(sid, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), hashes],
                names=["_d", "_h", "sid", "size", "bands"],
            )

    kind = rows.schema["_d"].dataType.simpleString()
    return _text(rows).mapInArrow(emit, f"_d {kind}, _h long, sid binary, size long, bands array<long>")


def _shingled(texts: DataFrame, n: int) -> DataFrame:
    """sid and shingles (binary) of rows with sid and _t."""
    import pyarrow as pa

    def emit(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = shingle_sets(*binary_parts(part.column("_t")), n)
                yield pa.RecordBatch.from_arrays([part.column("sid"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "shingles"])

    return _text(texts.select("sid", "_t")).mapInArrow(emit, "sid binary, shingles binary")


def similar(shared, a, b, threshold: float):
    """Whether sets of ``a`` and ``b`` shingles that share so many reach the threshold."""
    return shared >= threshold * (a + b - shared) - 1e-6


def _blocked(members: DataFrame, unit: str) -> DataFrame:
    """Add blocks (of the member's unit) and blk (the member's own)."""
    bound = members.groupBy(unit).agg(F.count("*").alias("m"), F.sum("size").alias("all"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("all") / BLOCK_SHINGLES)).cast("int")
    # Stored, as the side of a join that lets Spark split a hot unit's rows.
    bound = materialize(bound.select(unit, blocks.alias("blocks")), "blocks")
    return members.join(bound, unit).withColumn("blk", F.pmod(F.xxhash64("sid", F.lit(9)), "blocks").cast("int"))


def _grouped(batches: Iterator, keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Columns of the rows of each key, from batches that are sorted by it."""
    held: dict[str, list] | None = None
    for batch in batches:
        columns = {k: batch.column(k).to_pylist() for k in batch.schema.names}
        key = list(zip(*(columns[k] for k in keys), strict=True))
        first = 0
        for i in range(1, len(key) + 1):
            if i < len(key) and key[i] == key[first]:
                continue
            part = {k: v[first:i] for k, v in columns.items()}
            if held is not None and tuple(held[k][0] for k in keys) == key[first]:
                for k, v in part.items():
                    held[k] += v
            else:
                if held is not None:
                    yield held
                held = part
            first = i
    if held is not None:
        yield held


def _starred(links: DataFrame, sets: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The links (sid, hub) that hold at the threshold. A hub goes to every block of its members."""
    import pyarrow as pa

    members = _blocked(links.join(sets.select("sid", "size"), "sid"), "hub")
    centre = members.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk")).distinct()
    both = members.select("hub", "blk", "sid").unionByName(centre.select("hub", "blk", F.col("hub").alias("sid")))
    placed = both.join(shingles, "sid").repartition("hub", "blk").sortWithinPartitions("hub", "blk")

    def emit(batches: Iterator) -> Iterator:
        for unit in _grouped(batches, ("hub", "blk")):
            hub, out = unit["hub"][0], []
            centre = np.frombuffer(unit["shingles"][unit["sid"].index(hub)], U64)
            for sid, raw in zip(unit["sid"], unit["shingles"], strict=True):
                own = np.frombuffer(raw, U64)
                if sid == hub or min(len(own), len(centre)) < threshold * max(len(own), len(centre)) - 1e-6:
                    continue
                at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                if similar(int((centre[at] == own).sum()), len(own), len(centre), threshold):
                    out.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array([hub] * len(out), pa.binary())], names=["sid", "hub"])

    return placed.mapInArrow(emit, "sid binary, hub binary")


def _spread(members: DataFrame, shingles: DataFrame) -> DataFrame:
    """Rows of ``_blocked`` members for each pair of blocks (i, j) that needs them, with their shingles."""
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("blk", x).alias("i"), F.greatest("blk", x).alias("j"))))
    spread = members.withColumn("ij", pair).select("*", "ij.i", "ij.j").drop("ij", "blocks", "size")
    return spread.join(shingles, "sid").repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    g = len(sets)
    if g == 2:
        both = np.concatenate(sets)
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]])
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(new) - 1
    many = np.bincount(column)[column] > 1
    owner, column = owner[many], column[many]
    out = np.zeros((g, g), np.float32)  # counts under 2**24 are exact
    if len(column):
        column = np.cumsum(np.append(False, column[1:] != column[:-1]))
        wide = 4096
        cuts = np.searchsorted(column, np.arange(0, column[-1] + wide + 1, wide))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            m = np.zeros((g, wide), np.float32)
            m[owner[a:b], column[a:b] - k * wide] = 1
            out += m @ m.T
    out[np.arange(g), np.arange(g)] = [len(s) for s in sets]
    return out


def _linked(spread: DataFrame, threshold: float, across: bool) -> DataFrame:
    """sid, root (least linked set in this unit), docs and texts (numbers of links found here).

    across=False: all pairs of the unit. across=True: pairs of different groups whose first common band is the unit's.
    """
    import pyarrow as pa

    def work(unit: dict[str, list], out: dict) -> None:
        sids = unit["sid"]
        if len(sids) < 2:
            return
        apart = np.ones((len(sids), len(sids)), bool)
        if unit["i"][0] != unit["j"][0]:  # pairs inside a block belong to the block's own unit
            side = np.array(unit["blk"])
            apart = side[:, None] != side[None, :]
        if across:
            _, group = np.unique(np.array(unit["root"], dtype=object).astype("S16"), return_inverse=True)
            apart &= group[:, None] != group[None, :]
            own = np.array(unit["bands"], np.int64)
            for k in range(unit["band"][0]):
                apart &= own[:, k][:, None] != own[:, k][None, :]
        np.fill_diagonal(apart, False)
        some = apart.any(1)
        if not some.any():
            return
        at = np.flatnonzero(some)
        apart = apart[np.ix_(at, at)]
        sets = [np.frombuffer(unit["shingles"][k], U64) for k in at]
        size = np.array([len(s) for s in sets])
        link = apart & similar(overlaps(sets), size[:, None], size[None, :], threshold)
        if not link.any():
            return
        sids, copies = [sids[k] for k in at], np.array([unit["copies"][k] for k in at])
        order = sorted(range(len(sids)), key=sids.__getitem__)
        label = np.empty(len(sids), np.int64)
        label[order] = np.arange(len(sids))
        while True:  # least label among linked sets, until none changes
            low = np.minimum(label, np.where(link, label[None, :], len(sids)).min(1))
            if (low == label).all():
                break
            label = low
        docs, texts = link @ copies, link.sum(1)
        for k in np.flatnonzero(texts).tolist():
            out["sid"].append(sids[k])
            out["root"].append(sids[order[label[k]]])
            out["docs"].append(int(docs[k]))
            out["texts"].append(int(texts[k]))

    def emit(batches: Iterator) -> Iterator:
        for unit in _grouped(batches, ("unit", "i", "j")):
            out: dict = {"sid": [], "root": [], "docs": [], "texts": []}
            work(unit, out)
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return spread.mapInArrow(emit, "sid binary, root binary, docs long, texts long")


def jaccard_classes(rows: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """For rows of ``keyed``: _d, _h, sid, class (name of its group of linked sets), n_links and n_text_links.

    n_links counts the other documents at the threshold or above, copies included; n_text_links the
    different shingle sets among them.
    """
    bands, per = choose_bands(threshold, recall)
    signed = materialize(_signed(rows, n, bands, per), "signed")
    sets = signed.where("sid is not null").groupBy("sid").agg(
        F.count("*").alias("copies"), F.min(F.struct("_d", "_h")).alias("rep"), F.first("bands").alias("bands"), F.first("size").alias("size")
    )
    sets = materialize(sets, "sets")
    band = sets.select("sid", F.posexplode("bands").alias("band", "hash"))
    hubs = band.groupBy("hash").agg(F.min("sid").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    hubs = materialize(hubs, "hubs")  # as a stored side, so that Spark can split a hot bucket's rows
    placed = materialize(band.join(hubs, "hash"), "buckets")

    known = placed.select("sid").distinct().join(sets.select("sid", "rep"), "sid").select("sid", F.col("rep._d").alias("_d2"), F.col("rep._h").alias("_h2"))
    # Both grow with the corpus, so the texts are shuffled at every size.
    texts = rows.join(known.hint("merge"), F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2"))).dropDuplicates(["sid"])
    shingles = materialize(_shingled(texts, n), "shingles")
    star = materialize(_starred(placed.where("sid <> hub").select("sid", "hub").distinct(), sets, shingles, threshold), "star")
    groups = materialize(components(star.select(F.col("sid").alias("a"), F.col("hub").alias("b"))).withColumnsRenamed({"node": "sid"}), "groups")

    facts = sets.select("sid", "copies", "size")
    inside = _blocked(groups.join(facts, "sid").withColumnRenamed("root", "unit"), "unit")
    links = materialize(_linked(_spread(inside, shingles), threshold, across=False), "inside")

    # Buckets of several groups; of those with the same members, the one of the first band.
    told = materialize(placed.join(groups, "sid", "left").select("sid", "band", "hash", F.coalesce("root", "sid").alias("root")), "placed")
    mixed = told.groupBy("hash", "band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("s"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    mixed = mixed.where("r0 <> r1").groupBy("n", "s").agg(F.min(F.struct("band", "hash")).alias("x")).select(F.col("x.hash").alias("unit"))
    between = told.withColumnRenamed("hash", "unit").join(materialize(mixed, "mixed"), "unit").join(sets.select("sid", "copies", "size", "bands"), "sid")
    more = materialize(_linked(_spread(_blocked(materialize(between, "between"), "unit"), shingles), threshold, across=True), "across")
    links = links.unionByName(more)
    roots = groups.withColumnRenamed("root", "class")
    if not more.isEmpty():
        edges = star.select(F.col("sid").alias("a"), F.col("hub").alias("b")).unionByName(more.select(F.col("sid").alias("a"), F.col("root").alias("b")))
        roots = components(edges).withColumnsRenamed({"node": "sid", "root": "class"})
    counts = links.groupBy("sid").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    told = sets.select("sid", "copies").join(counts, "sid", "left").join(roots, "sid", "left")
    told = told.select("sid", "copies", F.coalesce("class", "sid").alias("class"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    out = signed.drop("bands", "size").join(told, "sid", "left")
    return out.select("_d", "_h", "sid", "class", F.coalesce(F.col("docs") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"))


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, class_id (least id of its class), n_links and n_text_links."""
    got = materialize(jaccard_classes(keyed(docs, id_col, text_col), n, threshold, recall), "classes")
    least = got.where("class is not null").groupBy("class").agg(F.min("_d").alias("class_id"))
    least = materialize(least, "class-ids")  # as a stored side, so that Spark can split a large class's rows
    return got.join(least, "class", "left").select(F.col("_d").alias(id_col), F.when(F.col("class").isNull(), F.col("_d")).otherwise(F.col("class_id")).alias("class_id"), "n_links", "n_text_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row with the least id, and all rows without words."""
    rows = keyed(docs, id_col, text_col)
    got = materialize(jaccard_classes(rows), "classes")
    keep = got.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("_d").isNull().alias("z"), "_d", "_h")).alias("k"))
    keep = keep.select(F.struct("k._d", F.coalesce("k._h", F.lit(0)).alias("_h")).alias("kept")).distinct()  # the type of the key, nullability included
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Whole rows travel as one column, so that no name of theirs can clash.
    full = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("_d"), F.xxhash64(text).alias("_h")).alias("key"), text.rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    # Rows equal in id and text are one class: one of them stays. The join is on the same key (structs with equal
    # nulls are equal), so texts are shuffled once.
    some = full.where("worded").groupBy("key").agg(F.first("row").alias("row"))
    some = some.join(keep.hint("merge"), some["key"] == keep["kept"], "left_semi")
    return some.select("row.*").unionByName(full.where("not worded").select("row.*"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: class and number of links of every document."""
    return jaccard_join(table(spark, sf_dir, "documents"))
