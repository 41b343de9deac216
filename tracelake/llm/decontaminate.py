"""Benchmark decontamination by spaced seeds.

A mask such as ``110101011`` is laid over each run of its length in a text; only the tokens under a 1 are hashed, so a
replaced token under a 0 does not hide the run. Hashes of training texts are joined with those of the
benchmark. Each hit fixes an alignment, and the aligned tokens of the whole item are compared one by one: a document is
contaminated if some region of ``REGION`` tokens of the item (or all of it, if shorter) has at least ``SHARE`` of its tokens at the same
places in the document.

Tokens are runs of letters and digits, lower-cased. Items shorter than a mask are sought as one unbroken run of their
own length; items under ``LEAST_TOKENS`` tokens, null or empty items and texts match nothing. Rows that repeat an id are judged
one by one and reported once; a null id is reported as null. Only the named columns are read.

Items of one text are sought and judged once. The benchmark side is broadcast while its windows are few; else the windows that a bit set of bounded size lets through
are joined by shuffles, with equal results. Hits are (document, text, start) only, each once; the documents that have any are read again to be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import stage

MASKS = ("110101011", "1011001101")
REGION = 20
SHARE = 0.8
LEAST_TOKENS = 5
#: Most rows of hits and documents, and of the benchmark's windows, that are broadcast.
BROADCAST_ROWS, SEED_ROWS = 1_000_000, 200_000
#: Bits of a block of the bit set, and most blocks (64 MB).
BLOCK_BITS, MOST_BLOCKS = 1 << 16, 8_192


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _window(mask: str, words: Column, at: Column) -> Column:
    """Hash of the tokens under the mask at a position; null where the mask reaches beyond the text."""
    held = [F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *held))


def _seeds(bench: DataFrame, item_id: str, text: str, masks: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Which text (``of``) an item has, the distinct texts, their seeds, and all masks. Items of one text are sought and judged once."""
    items = bench.select(F.col(item_id).alias("item_id"), tokens(F.col(text)).alias("item")).where(F.col("item_id").isNotNull() & (F.size("item") >= LEAST_TOKENS))
    items = stage(items)
    texts = stage(items.select("item").distinct().withColumn("of", F.monotonically_increasing_id()))
    named = stage(items.join(texts, "item").select("item_id", "of").distinct())
    span = max(map(len, masks))
    short = texts.where(F.size("item") < span).select(F.size("item").alias("n")).distinct().collect()  # fewer values than a mask is long
    runs = ["1" * r.n for r in sorted(short)]
    at = texts.select("of", "item", F.posexplode("item").alias("item_at", "_"))
    cases = [_window(m, F.col("item"), F.col("item_at")) for m in masks]
    cases += [F.when(F.size("item") == len(m), _window(m, F.col("item"), F.col("item_at"))) for m in runs]
    seeds = at.select("of", "item_at", F.explode(F.array(*cases)).alias("seed")).where("seed IS NOT NULL").distinct()
    return named, texts, stage(seeds), [*masks, *runs]


def _likely(windows: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """Windows whose seed may be one of the ``n`` seeds: all that are, and few others, told by a bit set of 16 bits a seed and of bounded size."""
    blocks = min(MOST_BLOCKS, -(-max(n, 1) // (BLOCK_BITS // 16)))
    block = F.pmod(F.shiftrightunsigned("seed", 48), F.lit(blocks)).cast("int").alias("block")
    places = [F.shiftrightunsigned("seed", shift).bitwiseAND(BLOCK_BITS - 1).cast("int") for shift in (0, 16, 32)]
    ones = seeds.select(block, F.explode(F.array(*places)).alias("p")).selectExpr("block", "p div 64 AS word", "shiftleft(1L, p % 64) AS bit")
    empty = seeds.sparkSession.range(blocks * BLOCK_BITS // 64).selectExpr(f"CAST(id div {BLOCK_BITS // 64} AS INT) AS block", f"id % {BLOCK_BITS // 64} AS word", "0L AS bit")
    words = ones.unionByName(empty).groupBy("block", "word").agg(F.bit_or("bit").alias("bit"))
    sets = stage(words.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bit"))), lambda x: x["bit"]).alias("bits")))
    held = [F.getbit(F.get("bits", F.shiftright(p, 6)), p.bitwiseAND(63)) == 1 for p in places]
    return windows.withColumn("block", block).join(F.broadcast(sets), "block").where(held[0] & held[1] & held[2]).drop("block", "bits")


def _best_region() -> Column:
    """Most equal tokens in a region of the item, by a sum that moves along ``equal``."""
    width = F.least(F.lit(REGION), F.size("equal"))

    def moved(acc: Column, i: Column) -> Column:
        total = acc["total"] + F.get("equal", i) - F.when(i >= width, F.get("equal", i - width)).otherwise(0)
        return F.struct(total.alias("total"), F.when(i >= width - 1, F.greatest(acc["most"], total)).otherwise(0).alias("most"))

    return F.aggregate(F.sequence(F.lit(0), F.size("equal") - 1), F.struct(F.lit(0).alias("total"), F.lit(0).alias("most")), moved, lambda acc: acc["most"])


def overlaps(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, item_tokens, matched (equal tokens on the best alignment), start (its first token in the text)."""
    named, texts, seeds, all_masks = _seeds(bench, item_id, item_text, masks)
    n = seeds.count()
    few = n <= min(BROADCAST_ROWS, SEED_ROWS)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    at = rows.select("doc_id", tokens(F.col("text")).alias("words")).select("doc_id", "words", F.posexplode("words").alias("at", "_"))
    windows = at.select("doc_id", "at", F.explode(F.array(*[_window(m, F.col("words"), F.col("at")) for m in all_masks])).alias("seed"))
    windows = windows.join(F.broadcast(seeds), "seed") if few else _likely(windows.where("seed IS NOT NULL"), seeds, n).join(seeds, "seed")
    # an alignment is hit by nearly each of its windows, and is judged once
    hits = stage(windows.select("doc_id", "of", (F.col("at") - F.col("item_at")).alias("start")).distinct())
    hit_docs = hits.select("doc_id").distinct()
    if hits.count() <= BROADCAST_ROWS:
        hits, hit_docs = F.broadcast(hits), F.broadcast(hit_docs)
    held = rows.alias("r").join(hit_docs.alias("h"), F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")), "left_semi").select("doc_id", tokens(F.col("text")).alias("words"))
    found = held.alias("w").join(hits.alias("h"), F.col("w.doc_id").eqNullSafe(F.col("h.doc_id"))).select("w.doc_id", "words", "of", "start").join(F.broadcast(texts) if few else texts, "of")
    aligned = F.transform("item", lambda x, i: F.when(F.get(F.col("words"), F.col("start") + i) == x, 1).otherwise(0))
    found = found.select("doc_id", "of", "start", F.size("item").alias("item_tokens"), aligned.alias("equal"))
    matched = F.aggregate("equal", F.lit(0), lambda a, x: a + x)
    judged = found.select("doc_id", "of", "item_tokens", "start", matched.alias("matched"), _best_region().alias("region"))
    # held in the aggregate: a filter would go below the alignments and work each of them out again
    dirty = F.when(F.col("region") >= F.ceil(SHARE * F.least(F.lit(REGION), "item_tokens")), F.struct("matched", (-F.col("start")).alias("back")))
    best = judged.groupBy("doc_id", "of").agg(F.max("item_tokens").alias("item_tokens"), F.max(dirty).alias("best")).where("best IS NOT NULL")
    best = best.join(named, "of").groupBy("doc_id", "item_id").agg(F.max("item_tokens").alias("item_tokens"), F.max("best").alias("best"))
    return best.select("doc_id", "item_id", "item_tokens", F.col("best.matched").alias("matched"), (-F.col("best.back")).alias("start"))


def clean(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that overlap no benchmark item, unchanged."""
    dirty = stage(overlaps(docs, bench, doc_id, text).select(F.col("doc_id").alias("_dirty")).distinct())
    if dirty.count() <= BROADCAST_ROWS:
        dirty = F.broadcast(dirty)
    return docs.join(dirty, docs[doc_id].eqNullSafe(F.col("_dirty")), "left_anti")


def oracle_sql(masks: tuple[str, ...] = MASKS) -> str:
    """The same rows in SQL."""
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    span = max(map(len, masks))
    shapes = [(m, "TRUE") for m in masks] + [("1" * n, f"len(item) = {n}") for n in range(LEAST_TOKENS, span)]

    def windows(table: str, key: str, words: str, mask: str, where: str) -> str:
        held = " || ' ' || ".join(f"{words}[p + {i + 1}]" for i, bit in enumerate(mask) if bit == "1")
        return f"SELECT {key}, p, '{mask}' AS mask, {held} AS seed FROM (SELECT *, unnest(range(len({words}) - {len(mask) - 1})) AS p FROM {table} WHERE len({words}) >= {len(mask)} AND {where})"

    doc_windows = " UNION ALL ".join(windows("d", "doc_id", "words", m, "TRUE") for m, _ in shapes)
    item_windows = " UNION ALL ".join(windows("b", "item_id", "item", m, w) for m, w in shapes)
    return f"""
        WITH d AS (SELECT doc_id, {words} AS words FROM documents),
        b AS (SELECT * FROM (SELECT item_id, {words} AS item FROM benchmark) WHERE len(item) >= {LEAST_TOKENS}),
        dw AS ({doc_windows}), bw AS ({item_windows}),
        hits AS (SELECT DISTINCT doc_id, item_id, dw.p - bw.p AS start FROM dw JOIN bw USING (mask, seed)),
        equals AS (SELECT doc_id, item_id, start, len(item) AS item_tokens,
                          list_transform(range(len(item)), lambda i: CASE WHEN start + i >= 0 AND words[start + i + 1] = item[i + 1] THEN 1 ELSE 0 END) AS equal
                   FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
        judged AS (SELECT doc_id, item_id, start, item_tokens, list_sum(equal) AS matched, least({REGION}, item_tokens) AS width,
                          list_max(list_transform(range(item_tokens - least({REGION}, item_tokens) + 1),
                                                  lambda s: list_sum(list_slice(equal, s + 1, s + least({REGION}, item_tokens))))) AS region
                   FROM equals)
        SELECT doc_id, item_id, CAST(item_tokens AS INT) AS item_tokens, CAST(max(matched) AS INT) AS matched,
               CAST(arg_max(start, matched * 1000000000 - start) AS INT) AS start
        FROM judged WHERE region >= ceil({SHARE} * width) GROUP BY doc_id, item_id, item_tokens"""
