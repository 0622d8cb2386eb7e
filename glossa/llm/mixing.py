"""Mixing of sources to target weights, in DataFrame operations only.

The words of a source's documents, laid end to end in a pseudorandom order,
are packed into blocks of ``block_words``.  A source's target is its share of
all words by weight, stopped at ``limit`` times its size; the excess is shared
again by weight among the others.  The mix is a row of slots, each of which
takes one block, dealt into output shards of ``shard_slots``:

1. Each shard draws its source counts from the multinomial of the targets:
   every slot draws a number below the count of all slots, and the source
   whose interval holds it is found by an equi-join on cells of that range.
2. Where a source was drawn more often than it has slots, a pseudorandom part
   of them goes to the sources that were drawn too seldom, so that targets are
   met exactly.  A source's slots are then numbered through the shards.
3. Slot k of a source with n blocks takes, in its pass k div n, the block to
   which a permutation of 0..n-1 maps k mod n.  The permutation is the
   swap-or-not shuffle: pointwise, for any n, without a table.  Each pass has
   another one.  The last slot of a source takes only the words still due.
4. Slots and documents meet by an equi-join on (source, block).

All draws are MD5 values of keys, so a rerun gives the same rows.  Hot sources
are spread by chunks of documents and by blocks, running sums are taken in two
levels, and rows that repeat are counted before they are shuffled and spread
again in pieces of ``PIECE``.

Edge cases: a null text has no words; documents without words are never taken;
sources are ordered by code point, null (a source of its own) last; rows that
repeat a doc_id are documents of their own (equal rows: in any order); an empty
table or one without words gives targets of 0; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sums, ranked, table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source whose sizes one window sums (about); a hot source is many windows.
CHUNK = 1 << 12
#: Equal rows that stay together.
PIECE = 1000
#: Steps of the swap-or-not shuffle.
ROUNDS = 12


def draw(*parts) -> Column:
    """A number of 48 bits from the key made of ``parts``."""
    return F.conv(F.substring(_md5(*parts), 1, 12), 16, 10).cast("long")


def _md5(*parts) -> Column:
    texts = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *texts))


def permuted(x: Column, n: Column, keys: Column, *name) -> Column:
    """The place to which the swap-or-not shuffle with ``keys`` (structs of step
    and key) moves ``x``, one of 0..n-1.  Reversed keys undo it."""
    def step(at, k):
        other = F.pmod(k["key"] + n - at, n)
        swap = F.substring(_md5(*name, k["step"], F.greatest(at, other)), 1, 1) < F.lit("8")
        return F.when(swap, other).otherwise(at)

    return F.aggregate(keys, x.cast("long"), step)


def entries(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, doc_id, size, digest, copies): equal rows counted."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").alias("doc_id"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text).alias("digest"))
    return written(rows.groupBy("source", "doc_id", "size", "digest").agg(F.count(F.lit(1)).alias("copies")), "mix-entries")


def targets(found: DataFrame, weights=(1, 2, 3), limit: int = 3) -> DataFrame:
    """(source, no, source_size, weight, target) for (source, size, copies)."""
    sizes = found.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    numbered = ranked(sizes, [F.asc_nulls_last("source")], "no")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int"))
    plan = written(numbered.withColumn("weight", weight), "mix-sources")
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    left, shares, full = total, plan.agg(F.sum("weight")).first()[0] or 1, -1
    while True:  # the level rises until no further source is full
        level = F.lit(float(left)) * F.col("weight") / F.lit(float(shares or 1))
        over = F.lit(float(limit)) * F.col("source_size") < level
        used, open_shares, n = plan.agg(F.sum(F.when(over, limit * F.col("source_size"))), F.sum(F.when(~over, F.col("weight"))),
                                        F.count(F.when(over, 1))).first()
        if n == full or not open_shares:
            break
        left, shares, full = total - (used or 0), open_shares, n
    return plan.select("source", "no", "source_size", "weight", F.least(level, F.lit(float(limit)) * F.col("source_size")).alias("target"))


def _keys(seed: int, epoch: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda i: F.struct(
        i.alias("step"), F.pmod(draw(seed, "key", F.col("no"), epoch, i), F.col("blocks")).alias("key")))


def budgets(plan: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Adds to each source with words: blocks, the words ``rest`` of the last,
    partial pass, the place ``short_at`` of the short block in it, and the
    number of its slots."""
    b = F.lit(block_words)
    p = plan.filter("source_size > 0").withColumn("goal", F.floor(F.col("target") + 0.5)).withColumn(
        "blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}")).withColumn(
        "passes", F.expr("goal div source_size")).withColumn("rest", F.expr("goal % source_size"))
    p = p.withColumn("keys", _keys(seed, F.col("passes"))).withColumn(
        "short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.reverse("keys"), seed, F.col("no"), F.col("passes"))).drop("keys").withColumn(
        "short", F.col("source_size") - (F.col("blocks") - 1) * b)
    up = lambda x: F.expr(f"({x} + {block_words - 1}) div {block_words}")
    more = F.when(F.col("rest") <= F.col("short_at") * b, up("rest")).when(
        F.col("rest") <= F.col("short_at") * b + F.col("short"), F.col("short_at") + 1).otherwise(up(f"rest + {block_words} - short"))
    return p.withColumn("slots", F.col("passes") * F.col("blocks") + more)


def drawn_slots(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, no, k): the multinomial draws of all shards, with every
    source's slots 0..slots-1 used once each."""
    spark = plan.sparkSession
    total, sources = plan.agg(F.sum("slots"), F.count(F.lit(1))).first()
    total = total or 0
    width = max(1, total // max(1024, sources))
    placed = prefix_sums(plan.select("no", "slots"), [], "no", "slots", "first").filter("slots > 0")
    cells = placed.select("no", "slots", "first", F.explode(F.expr(f"sequence(first div {width}, (first + slots - 1) div {width})")).alias("cell"))
    draws = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id div {shard_slots}").alias("shard"),
                                      F.pmod(draw(seed, "slot", F.col("id")), F.lit(max(total, 1))).alias("x"))
    hit = draws.withColumn("cell", F.expr(f"x div {width}")).join(cells, "cell").filter("x >= first and x < first + slots")
    # a source's draws beyond its number of slots, the last by another draw, are free again
    chunks = max(1, total // shard_slots)
    kept = draw(seed, "keep", F.col("slot"))
    hit = hit.select("slot", "shard", "no", "slots", kept.alias("h")).withColumn("chunk", F.expr(f"h div {max(1, (1 << 48) // chunks)}"))
    near = Window.partitionBy("no", "chunk").orderBy("h", "slot")
    drawn = written(hit.withColumn("i", F.row_number().over(near)), "mix-draws")
    counts = prefix_sums(drawn.groupBy("no", "chunk").agg(F.count(F.lit(1)).alias("n")), ["no"], "chunk", "n", "before")
    drawn = written(drawn.join(counts.select("no", "chunk", "before"), ["no", "chunk"]).select(
        "shard", "slot", "no", (F.col("before") + F.col("i") > F.col("slots")).alias("over")), "mix-kept")
    free = _numbered(drawn.filter("over").select("shard", "slot"), [], "f")
    have = drawn.filter("not over").groupBy("no").agg(F.count(F.lit(1)).alias("n"))
    lack = placed.join(have, "no", "left").withColumn("m", F.col("slots") - F.coalesce("n", F.lit(0))).filter("m > 0")
    lack = prefix_sums(lack.select("no", "m"), [], "no", "m", "before")
    lack = lack.select("no", "before", F.explode(F.expr("sequence(cast(0 as bigint), m - 1)")).alias("j")).select("no", (F.col("before") + F.col("j")).alias("f"))
    dealt = drawn.filter("not over").select("shard", "slot", "no").unionByName(free.join(lack, "f").select("shard", "slot", "no"))
    return _numbered(written(dealt, "mix-slots"), ["no"], "k")


def _numbered(slots: DataFrame, group: list[str], name: str) -> DataFrame:
    """Adds ``name``: the number from 0 of each slot among those of its group."""
    inside = F.row_number().over(Window.partitionBy(*group, "shard").orderBy("slot"))
    counts = prefix_sums(slots.groupBy(*group, "shard").agg(F.count(F.lit(1)).alias("n")), group, "shard", "n", "before")
    return slots.withColumn("i", inside).join(counts.drop("n"), [*group, "shard"]).select("shard", "slot", *group, (F.col("before") + F.col("i") - 1).alias(name))


def slot_blocks(slots: DataFrame, plan: DataFrame, block_words: int, seed: int) -> DataFrame:
    """(shard, slot, no, pass, block, take): the block of each slot and how many of its words are taken."""
    by_pass = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass"))
    by_pass = by_pass.withColumn("keys", _keys(seed, F.col("pass"))).select(
        "no", "pass", "keys", "blocks", "passes", "rest", "short_at", "short")
    numbers = plan.select("no", "blocks")
    at = slots.join(numbers, "no").select("shard", "slot", "no", F.expr("k div blocks").alias("pass"), F.expr("k % blocks").alias("i"))
    both = at.join(by_pass, ["no", "pass"])
    size = F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(block_words).cast("long"))
    gone = F.col("i") * block_words - F.when(F.col("i") > F.col("short_at"), F.lit(block_words) - F.col("short")).otherwise(0)
    return both.withColumn("block", permuted(F.col("i"), F.col("blocks"), F.col("keys"), seed, F.col("no"), F.col("pass"))).select(
        "shard", "slot", "no", "pass", "block",
        F.when(F.col("pass") < F.col("passes"), size).otherwise(F.least(size, F.col("rest") - gone)).cast("long").alias("take"))


def placed_documents(found: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(no, doc_id, size, digest, place): each document with words and where it starts among the words of its source."""
    total = found.count()
    chunks = max(1, -(-total // CHUNK))
    number = plan.select(F.col("source").alias("name"), "no")
    pieces = found.filter("size > 0").join(number, F.col("source").eqNullSafe(F.col("name"))).select(
        "no", "doc_id", "size", "digest", "copies", F.explode(F.expr(f"sequence(cast(0 as bigint), (copies - 1) div {PIECE})")).alias("piece"))
    h = _md5(seed, "doc", F.col("doc_id"), F.col("digest"), F.col("piece"))
    pieces = pieces.withColumn("n", F.least(F.lit(PIECE).cast("long"), F.col("copies") - F.col("piece") * PIECE)).withColumn("h", h)
    chunk = F.expr(f"(cast(conv(substring(h, 1, 8), 16, 10) as bigint) * {chunks}) div 4294967296")
    words = F.col("size") * F.col("n")
    near = Window.partitionBy("no", "chunk").orderBy("h")
    pieces = written(pieces.withColumn("chunk", chunk).withColumn("inside", F.sum(words).over(near) - words), "mix-pieces")
    sums = pieces.groupBy("no", "chunk").agg(F.sum(words).alias("words"))
    before = prefix_sums(sums, ["no"], "chunk", "words", "before").select("no", "chunk", "before")
    return pieces.join(before, ["no", "chunk"]).select("no", "doc_id", "size", "digest", F.explode(F.expr("sequence(cast(0 as bigint), n - 1)")).alias("copy"),
                                                       (F.col("before") + F.col("inside")).alias("base")).select(
        "no", "doc_id", "size", "digest", (F.col("base") + F.col("copy") * F.col("size")).alias("place"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), limit: int = 3,
        block_words: int = 256, shard_slots: int = 4096, seed: int = 17):
    """Returns (spans, documents, sources).

    ``spans``: shard, slot, pass, block, at (word in the block), no, place,
    doc_id, digest, start (word in the document), n_words; a slot's text is its
    spans in the order of ``at``.  ``documents``: no, doc_id, size, digest and
    place (null without words).  ``sources``: source, no, source_size, weight,
    target."""
    found = entries(docs, id_col, text_col, source_col)
    sources = written(targets(found, weights, limit), "mix-targets")
    plan = written(budgets(sources, block_words, seed), "mix-plan")
    blocks = slot_blocks(drawn_slots(plan, shard_slots, seed), plan, block_words, seed)
    placed = written(placed_documents(found, sources, seed), "mix-placed")
    parts = placed.select("*", F.explode(F.expr(f"sequence(place div {block_words}, (place + size - 1) div {block_words})")).alias("block"))
    first = F.greatest(F.col("place"), F.col("block") * block_words)
    stop = F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * block_words)
    parts = parts.select("no", "block", "place", "doc_id", "digest", (first - F.col("block") * block_words).alias("at"),
                         (first - F.col("place")).alias("start"), (stop - first).alias("length"))
    spans = blocks.join(parts, ["no", "block"]).withColumn("n_words", F.least("length", F.col("take") - F.col("at"))).filter("n_words > 0").select(
        "shard", "slot", "pass", "block", "at", "no", "place", "doc_id", "digest", "start", "n_words")
    wordless = found.filter("size = 0").withColumn("copy", F.explode(F.expr(f"sequence(cast(0 as bigint), (copies - 1) div {PIECE})"))).withColumn(
        "n", F.least(F.lit(PIECE).cast("long"), F.col("copies") - F.col("copy") * PIECE))
    wordless = wordless.join(sources.select(F.col("source").alias("name"), "no"), F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "copy", F.explode(F.expr("sequence(cast(1 as bigint), n)")))
    documents = placed.unionByName(wordless.select("no", "doc_id", "size", "digest", F.lit(None).cast("long").alias("place")))
    return spans, documents, sources


def slot_texts(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, slot, text): the words of each slot, joined by one space."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("d"), F.md5(text).alias("g"), text.alias("t")).distinct()
    cut = spans.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).select(
        "shard", "slot", "at", F.array_join(F.slice(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), (F.col("start") + 1).cast("int"),
                                                    F.col("n_words").cast("int")), " ").alias("words"))
    return cut.groupBy("shard", "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))),
                                                                     lambda s: s["words"]), " ").alias("text"))  # one block at most


def op12_source_mixing(spark, sf_dir):
    """How many words the mix of all ``documents`` takes of each."""
    spans, documents, sources = mix(table(spark, sf_dir, "documents"))
    key = ["no", "place", "doc_id", "size"]
    some = documents.filter("place is not null").select(*key, F.lit(0).cast("long").alias("taken"))
    used = spans.groupBy("no", "place").agg(F.sum("n_words").alias("taken")).select(
        "no", "place", F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("size"), "taken")
    taken = some.unionByName(used).groupBy("no", "place").agg(F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.sum("taken").alias("taken"))
    none = documents.filter("place is null").select(*key, F.lit(0).cast("long").alias("taken"))
    every = taken.select(*key, "taken").unionByName(none)
    return every.join(sources.select("no", "source_size", "target"), "no").select("doc_id", "size", "source_size", "target", "taken")


def _sql_permuted(x: str, n: str, keys: str, name: str) -> str:
    other = f"((k.key + {n} - a) % {n})"
    return (f"list_reduce({keys}, lambda a, k: CASE WHEN substr(md5({name} || k.step || ':' || greatest(a, {other})), 1, 1) < '8' THEN {other} ELSE a END, "
            f"CAST({x} AS BIGINT))")


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, source, doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(text, '')) AS digest FROM documents
), s AS (
  SELECT *, (no - 1) % 3 + 1 AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source)
), full_first AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS left_words, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS shares
  FROM s WINDOW before AS (ORDER BY 3.0 * source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT left_words::DOUBLE AS words, shares::DOUBLE AS shares FROM full_first WHERE 3.0 * source_size >= left_words::DOUBLE * weight / shares::DOUBLE
  ORDER BY 3.0 * source_size / weight, no LIMIT 1
), t AS (
  SELECT s.*, least(words * weight / shares, 3.0::DOUBLE * source_size) AS target FROM s, level
), p0 AS (
  SELECT *, (source_size + 255) // 256 AS blocks, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t WHERE source_size > 0
), p1 AS (
  SELECT *, goal // source_size AS passes, goal % source_size AS rest, source_size - (blocks - 1) * 256 AS short FROM p0
), pass AS (
  SELECT *, list_transform(range({ROUNDS}), lambda i: {{'step': i, 'key': ('0x' || substr(md5('17:key:' || no || ':' || pass || ':' || i), 1, 12))::BIGINT % blocks}}) AS keys
  FROM (SELECT *, unnest(range(passes + 1)) AS pass FROM p1)
), p2 AS (
  SELECT *, {_sql_permuted("blocks - 1", "blocks", "list_reverse(keys)", "'17:' || no || ':' || pass || ':'")} AS short_at FROM pass WHERE pass = passes
), plan AS (
  SELECT *, passes * blocks + CASE WHEN rest <= short_at * 256 THEN (rest + 255) // 256 WHEN rest <= short_at * 256 + short THEN short_at + 1
                                   ELSE (rest + 256 - short + 255) // 256 END AS slots FROM p2
), spread AS (
  SELECT no, slots, sum(slots) OVER (ORDER BY no) - slots AS first, sum(slots) OVER () AS total FROM plan
), draws AS (
  SELECT slot, slot // 4096 AS shard, ('0x' || substr(md5('17:slot:' || slot), 1, 12))::BIGINT % total AS x
  FROM (SELECT unnest(range(total)) AS slot, total FROM (SELECT max(total)::BIGINT AS total FROM spread))
), drawn AS (
  SELECT slot, no, slots, row_number() OVER (PARTITION BY no ORDER BY substr(md5('17:keep:' || slot), 1, 12), slot) AS i
  FROM draws JOIN spread ON x >= first AND x < first + slots
), free AS (
  SELECT slot, row_number() OVER (ORDER BY slot) AS f FROM drawn WHERE i > slots
), lack AS (
  SELECT no, row_number() OVER (ORDER BY no, i) AS f FROM (SELECT no, unnest(range(slots)) + 1 AS i FROM spread) ANTI JOIN drawn USING (no, i)
), slots AS (
  SELECT no, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS k
  FROM (SELECT slot, no FROM drawn WHERE i <= slots UNION ALL SELECT slot, no FROM free JOIN lack USING (f))
), taken_block AS (
  SELECT no, block, CASE WHEN pass < passes THEN size ELSE least(size, rest - (i * 256 - CASE WHEN i > short_at THEN 256 - short ELSE 0 END)) END AS take
  FROM (SELECT *, CASE WHEN block = blocks - 1 THEN short ELSE 256 END AS size FROM (
    SELECT *, {_sql_permuted("i", "blocks", "keys", "'17:' || no || ':' || pass || ':'")} AS block FROM (
      SELECT slots.no, k // plan.blocks AS pass, k % plan.blocks AS i, plan.passes, plan.rest, plan.short, plan.short_at, plan.blocks FROM slots JOIN plan USING (no))
    JOIN (SELECT no, pass, keys FROM pass) USING (no, pass)))
), copies AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, digest ORDER BY r) - 1 AS copy FROM d WHERE size > 0
), hashed AS (
  SELECT *, md5('17:doc:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest || ':' || copy // {PIECE}) AS h FROM copies
), placed AS (
  SELECT r, no, size, sum(size) OVER (PARTITION BY no ORDER BY h, copy) - size AS place FROM hashed JOIN s ON hashed.source IS NOT DISTINCT FROM s.source
), part AS (
  SELECT r, no, block, greatest(place, block * 256) - block * 256 AS lo, least(place + size, block * 256 + 256) - block * 256 AS stop
  FROM (SELECT r, no, size, place, unnest(range(CAST(place // 256 AS BIGINT), CAST((place + size - 1) // 256 AS BIGINT) + 1)) AS block FROM placed)
), used AS (
  SELECT r, sum(greatest(least(stop, take) - lo, 0)) AS taken FROM taken_block JOIN part USING (no, block) GROUP BY r
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN used USING (r)
"""
