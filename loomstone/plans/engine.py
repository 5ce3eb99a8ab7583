"""All queries of the engine itself, each over its whole table, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import columns as C
from loomstone.functions import transforms as X
from loomstone.operators import codec, contexts, crypto, grouping, integrity, profile, sequence
from loomstone.plans.catalogue import Catalogue, table
from loomstone.sources import archive, tree
from loomstone.sources.store import shared_dir, written
from loomstone.streaming import strides as streaming

CATALOGUE = Catalogue()
add = CATALOGUE.add

#: Bytes of documents as rows (doc_id, b); hex of a byte to its number.
_BYTE = "(strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1"
_BYTES = f"""
doc_bytes AS (
  SELECT doc_id, i - 1 AS pos, {_BYTE} AS b
  FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h, unnest(range(1, octet_length(encode(text)) + 1)) AS i FROM documents))
"""


# Values made from the rows of ``part``, one kind for each last digit of the key, so that every routing rule is met: programs,
# another machine's program, archives, images, sound, text, all bytes alike, noise, video, and letters beyond ASCII
_RANDOM = [f"md5(p_name || '{i}')" for i in range(8)]
_ALL = bytes(range(256)).hex().upper()
_KINDS = (
    "'7F454C46020101' || repeat('00', 9) || '02003E00' || hex_name",
    "'7F454C46020101' || repeat('00', 9) || '0200B700' || hex_name",
    "'504B0304' || hex_name",
    f"'FFD8FF' || '{_ALL}'",
    "'5249464600000000' || '57415645' || hex_name",
    "hex_name",
    f"'00' || '{_ALL}'",
    "'00' || " + " || ".join(_RANDOM[:4]),
    "'0000001866747970' || " + " || ".join(_RANDOM),
    "'C3A9' || hex_name",
)
_MADE = f"""
made AS (SELECT p_partkey, p_partkey % 10 AS k, upper(CASE p_partkey % 10 {' '.join(f"WHEN {i} THEN {x}" for i, x in enumerate(_KINDS))} END) AS h
         FROM (SELECT *, hex(encode(p_name)) AS hex_name FROM part))
"""


def _made(spark: SparkSession, d: str) -> DataFrame:
    """p_partkey, value: the values of _MADE."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.hex(F.col("p_name").cast("binary")).alias("hex_name"))
    kind = F.expr("CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_KINDS)) + " END")
    return rows.select("p_partkey", F.unhex(kind).alias("value"))


# Records of four bytes, the quantity plus 100 in the lowest, of all line items of a supplier in order
_RECORDS = """
records AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity::INT + 100 AS q,
                   row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS k FROM lineitem),
record_bytes AS (SELECT l_suppkey, 4 * k + j AS pos, CASE WHEN j = 0 THEN q ELSE 0 END AS b FROM records, range(4) t(j))
"""


def _record_fragments(spark: SparkSession, d: str) -> DataFrame:
    """stream_id, offset, data: one record of a supplier's sequence in each row."""
    data = F.unhex(F.concat(F.lpad(F.hex(F.col("l_quantity").cast("int") + 100), 2, "0"), F.lit("000000")))
    place = (F.col("l_orderkey") * 64 + F.col("l_linenumber")).cast("long").alias("offset")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("stream_id"), place, data.alias("data"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """l_suppkey, value: the records of each supplier, joined."""
    rows = _record_fragments(spark, d).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("data").alias("h")))).alias("all"))
    return rows.select(F.col("stream_id").cast("long").alias("l_suppkey"), F.unhex(F.array_join("all.h", "")).alias("value"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


# Profiles


@add("byte_histogram", f"WITH {_BYTES} SELECT b::INT AS byte, count(*) AS n FROM doc_bytes GROUP BY b")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.byte_histogram(_docs(spark, d), "text")


@add(
    "merged_histogram",
    f"""WITH {_BYTES}, page_bytes AS (SELECT {_BYTE} AS b FROM (SELECT unnest(regexp_extract_all(hex(encode(html)), '..')) AS h FROM pages))
SELECT b::INT AS byte, count(*) AS n FROM (SELECT b FROM doc_bytes UNION ALL SELECT b FROM page_bytes) GROUP BY b""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.merge_histograms(profile.byte_histogram(_docs(spark, d), "text"), profile.byte_histogram(table(spark, d, "pages").select("html"), "html"))


_ENTROPY = """
counts AS (SELECT doc_id, b, count(*) AS c FROM doc_bytes GROUP BY doc_id, b),
h AS (SELECT doc_id, sum(c) AS n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM counts GROUP BY doc_id),
all_docs AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(e, 0) AS entropy FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id)
"""


@add("doc_entropy", f"WITH {_BYTES}, {_ENTROPY} SELECT doc_id, n_bytes, round(entropy, 6) AS entropy FROM all_docs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.entropies(_docs(spark, d), "text").select("doc_id", "n_bytes", F.round("entropy", 6).alias("entropy"))


@add(
    "order1_entropy",
    f"""WITH {_BYTES},
pairs AS (SELECT doc_id, lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS a, b FROM doc_bytes),
c2 AS (SELECT doc_id, a, b, count(*) AS c FROM pairs WHERE a IS NOT NULL GROUP BY ALL),
c1 AS (SELECT doc_id, a, sum(c) AS c FROM c2 GROUP BY ALL),
h2 AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c2 GROUP BY doc_id),
h1 AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c1 GROUP BY doc_id)
SELECT d.doc_id, round(greatest(coalesce(h2.e - h1.e, 0), 0), 6) AS order1_entropy
FROM documents d LEFT JOIN h2 ON d.doc_id = h2.doc_id LEFT JOIN h1 ON d.doc_id = h1.doc_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.entropies(_docs(spark, d), "text").select("doc_id", F.round("order1_entropy", 6).alias("order1_entropy"))


@add(
    "compression_estimate",
    f"""WITH {_BYTES}, {_ENTROPY}
SELECT doc_id, round(least(greatest(entropy / 8, 0), 1), 6) AS estimate, entropy > 7.95 AS incompressible FROM all_docs""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.entropies(_docs(spark, d), "text").select("doc_id", F.round("estimate", 6).alias("estimate"), "incompressible")


@add(
    "dominant_byte",
    f"""WITH {_BYTES}, counts AS (SELECT doc_id, b, count(*) AS c FROM doc_bytes GROUP BY doc_id, b),
tops AS (SELECT doc_id, arg_max(b, c * 1000 - b) AS b, max(c) AS c, sum(c) AS n FROM counts GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c > floor(0.40 * n) THEN b END::INT AS dominant_byte FROM documents d LEFT JOIN tops t ON d.doc_id = t.doc_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.entropies(_docs(spark, d), "text").select("doc_id", "dominant_byte")


def _log8(n: str) -> str:
    """log2 of a number from 1 in 24.8 fixed point: eight bits after the leading one pick the rounded fraction."""
    top = f"floor(log2({n}) + 1e-12)::BIGINT"
    return f"(256 * {top} + round(256 * log2(1 + ((({n}) * 256) // (1::BIGINT << ({top})::INT) % 256) / 256.0))::BIGINT)"


@add(
    "integer_entropy",
    f"""WITH {_BYTES}, counts AS (SELECT doc_id, b, count(*) AS c FROM doc_bytes GROUP BY doc_id, b),
sums AS (SELECT doc_id, sum(c)::BIGINT AS n, sum(c * {_log8("c")})::BIGINT AS s FROM counts GROUP BY doc_id)
SELECT d.doc_id, coalesce(greatest({_log8("n")} - s // n, 0), 0)::BIGINT AS integer_entropy FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.entropies(_docs(spark, d), "text").select("doc_id", "integer_entropy")


_SIGNATURE = f"""CASE WHEN head IS NULL THEN NULL
  {' '.join("WHEN " + " AND ".join(f"substr(head, {2 * at - 1}, {len(code)}) = '{code}'" for at, code in parts) + f" THEN '{name}'" for name, parts in C.SIGNATURES)}
  WHEN regexp_matches(head, '{C.ASCII_HEX}') THEN 'ascii'
  WHEN NOT regexp_matches(head, '{C.NUL_HEX}') AND regexp_matches(head, '{C.UTF8_HEX}') THEN 'utf8' ELSE 'unknown' END"""


@add("page_signature", f"SELECT page_id, {_SIGNATURE} AS signature FROM (SELECT page_id, substr(hex(encode(html)), 1, 512) AS head FROM pages)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", C.signature(F.col("html").cast("binary")).alias("signature"))


@add("text_ascii_flag", f"SELECT doc_id, regexp_matches(substr(hex(encode(text)), 1, 512), '{C.ASCII_HEX}') AS is_ascii FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", C.is_ascii(F.col("text").cast("binary")).alias("is_ascii"))


@add("made_signature", f"WITH {_MADE} SELECT p_partkey, {_SIGNATURE} AS signature FROM (SELECT p_partkey, substr(h, 1, 512) AS head FROM made)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("p_partkey", C.signature(F.col("value")).alias("signature"))


_PROGRAM = "substr(h, 1, 8) = '7F454C46' AND substr(h, 9, 2) IN ('01', '02') AND substr(h, 11, 2) = '01' AND substr(h, 37, 4) IN ('0300', '3E00')"


@add("x86_programs", f"WITH {_MADE} SELECT p_partkey, {_PROGRAM} AS program FROM made")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("p_partkey", C.is_x86_program(F.col("value")).alias("program"))


# Texts of any length that begin with a signature are all "ascii" or "utf8" here, so the text rule decides unless entropy is extreme
_CLASSES = f"""
sig AS (SELECT doc_id, {_SIGNATURE} AS signature FROM (SELECT doc_id, substr(hex(encode(text)), 1, 512) AS head FROM documents)),
classes AS (
  SELECT a.doc_id, n_bytes, entropy, signature,
    CASE WHEN signature IN ('zip', 'gz', 'bz2', 'xz', 'zstd', 'rar') OR entropy > 7.95 THEN 'incompressible'
         WHEN signature IN ('wav', 'flac') THEN 'multimedia'
         WHEN signature IN ('ascii', 'utf8') OR entropy < 4.5 AND signature <> 'unknown' THEN 'text' ELSE 'binary' END AS content_type,
    CASE WHEN signature IN ('zip', 'gz', 'bz2', 'xz', 'zstd', 'rar') OR entropy > 7.95 THEN 'store_raw'
         WHEN signature IN ('wav', 'flac') THEN 'multimedia'
         WHEN signature IN ('ascii', 'utf8') OR entropy < 4.5 AND signature <> 'unknown' THEN 'text' ELSE 'binary' END AS pipeline
  FROM all_docs a JOIN sig s ON a.doc_id = s.doc_id)
"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return profile.classify(_docs(spark, d), "text")


@add("classify_docs", f"WITH {_BYTES}, {_ENTROPY}, {_CLASSES} SELECT doc_id, signature, content_type, pipeline FROM classes")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("doc_id", "signature", "content_type", "pipeline")


_MADE_CLASSES = f"""
made_counts AS (SELECT p_partkey, x, count(*) AS c FROM (SELECT p_partkey, unnest(regexp_extract_all(h, '..')) AS x FROM made) GROUP BY ALL),
made_entropy AS (SELECT p_partkey, sum(c)::BIGINT AS n_bytes, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM made_counts GROUP BY p_partkey),
made_signature AS (SELECT p_partkey, {_PROGRAM} AS program, {_SIGNATURE} AS signature FROM (SELECT *, substr(h, 1, 512) AS head FROM made)),
ruled AS (
  SELECT e.p_partkey, n_bytes, entropy,
    CASE WHEN program THEN 1 WHEN signature IN ('jpeg', 'png', 'gif', 'bmp', 'webp') AND entropy > 7 THEN 2
         WHEN signature IN ('mp4', 'mkv', 'avi') AND entropy > 6.5 THEN 3 WHEN signature IN ('zip', 'gz', 'bz2', 'xz', 'zstd', 'rar') THEN 4
         WHEN entropy > 7.95 THEN 5 WHEN signature IN ('wav', 'flac') THEN 6
         WHEN signature IN ('ascii', 'utf8') OR entropy < 4.5 AND signature <> 'unknown' THEN 7 ELSE 8 END AS rule
  FROM made_entropy e JOIN made_signature s ON s.p_partkey = e.p_partkey),
made_classes AS (
  SELECT *, CASE WHEN rule = 1 THEN 'executable' WHEN rule <= 5 THEN 'incompressible' WHEN rule = 6 THEN 'multimedia' WHEN rule = 7 THEN 'text' ELSE 'binary' END AS content_type,
    CASE WHEN rule IN (1, 8) THEN 'binary' WHEN rule <= 5 THEN 'store_raw' WHEN rule = 6 THEN 'multimedia' ELSE 'text' END AS pipeline FROM ruled)
"""


@add(
    "routing_summary",
    f"""WITH {_MADE}, {_MADE_CLASSES}
SELECT content_type, pipeline, count(*) AS n_values, sum(n_bytes)::BIGINT AS n_bytes, round(avg(entropy), 6) AS mean_entropy FROM made_classes GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Values of all kinds: five classes by eight rules."""
    return profile.routing_summary(profile.classify(_made(spark, d), "value"))


@add(
    "routing_of_docs",
    f"""WITH {_BYTES}, {_ENTROPY}, {_CLASSES}
SELECT content_type, pipeline, count(*) AS n_values, sum(n_bytes)::BIGINT AS n_bytes, round(avg(entropy), 6) AS mean_entropy FROM classes GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.routing_summary(_classified(spark, d))


@add(
    "classification_join",
    f"""WITH {_BYTES}, {_ENTROPY}, {_CLASSES}
SELECT d.source || '/' || d.doc_id AS path, coalesce(content_type, 'binary') AS content_type, coalesce(pipeline, 'binary') AS pipeline
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN classes c ON c.doc_id = l.doc_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Files with the classification of those that are labelled; the others count as binary."""
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "source", "doc_id").alias("path")
    labelled = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(path, "text")
    return grouping.with_classification(docs.select(path), profile.classify(labelled, "text")).select("path", "content_type", "pipeline")


@add(
    "best_stride",
    f"""WITH {_RECORDS}, sample AS (SELECT * FROM record_bytes WHERE pos < 4096),
pairs AS (SELECT x.l_suppkey, s AS stride, count(*) AS n, corr(x.b, y.b) AS r
          FROM range(2, 17) t(s) JOIN sample x ON TRUE JOIN sample y ON y.l_suppkey = x.l_suppkey AND y.pos = x.pos + s GROUP BY ALL)
SELECT l_suppkey, arg_max(stride, round(greatest(r, 0), 5) * 1000000 - stride)::INT AS stride, round(max(r), 5) AS r
FROM pairs WHERE n > stride AND r IS NOT NULL AND NOT isnan(r) GROUP BY l_suppkey HAVING max(r) >= 0.5""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The rule for chunks: strides 2 to 16 of a sample of 4,096 bytes, r from 0.5 on; r to five places."""
    return profile.best_stride(profile.strides(_records(spark, d), "value", exact=True), ["l_suppkey"], 0.5)


@add(
    "event_autocorrelation",
    """SELECT event_type, lag, round(corr(value, CASE lag WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l7 END), 9) AS r
FROM (SELECT event_type, value, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 7) OVER w AS l7
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), (VALUES (1), (2), (7)) t(lag) GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.lagged_correlation(table(spark, d, "events"), "value", "event_id", [1, 2, 7], ["event_type"])
    return rows.withColumn("r", F.round("r", 9))


@add(
    "contextual_cost",
    f"""WITH {_BYTES}, pairs AS (SELECT lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS a, b FROM doc_bytes),
c AS (SELECT (a // 4)::INT AS context, b, count(*) AS c FROM pairs WHERE a IS NOT NULL GROUP BY ALL)
SELECT context, sum(c)::BIGINT AS n, round(sum(c) * log2(sum(c)) - sum(c * log2(c)), 3) AS cost_bits FROM c GROUP BY context""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    cost = profile.weighted_cost(profile.context_histogram(_docs(spark, d), "text", "msb6"), ["context"])
    return cost.withColumn("cost_bits", F.round("cost_bits", 3))


@add(
    "context_tables",
    f"""WITH {_BYTES}, pairs AS (SELECT lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS a, b FROM doc_bytes)
SELECT ((a // 4) % 5)::INT AS table_no, b::INT AS byte, count(*) AS n FROM pairs WHERE a IS NOT NULL GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of six bits, dealt to five tables."""
    tables = spark.range(64).select(F.col("id").cast("int").alias("context"), (F.col("id") % 5).cast("int").alias("table_no"))
    return profile.table_histogram(profile.context_histogram(_docs(spark, d), "text", "msb6"), tables)


@add(
    "password_strength",
    r"""SELECT c_custkey, CASE WHEN length(p) < 8 THEN 'weak' WHEN length(p) >= 20 THEN 'very_strong'
  WHEN length(p) >= 12 THEN CASE WHEN v >= 3 THEN 'strong' ELSE 'moderate' END WHEN v >= 3 THEN 'moderate' ELSE 'weak' END AS strength
FROM (SELECT c_custkey, p, regexp_matches(p, '[A-Z]')::INT + regexp_matches(p, '[a-z]')::INT + regexp_matches(p, '[0-9]')::INT + regexp_matches(p, '[^A-Za-z0-9]')::INT AS v
      FROM (SELECT c_custkey, substr(c_name || c_mktsegment, 1 + (c_custkey % 12)::INT, 4 + (c_custkey % 20)::INT) AS p FROM customer))""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    p = F.concat("c_name", "c_mktsegment").substr((1 + F.col("c_custkey") % 12).cast("int"), (4 + F.col("c_custkey") % 20).cast("int"))
    return profile.password_report(c.select("c_custkey", p.alias("p")), F.col("p")).select("c_custkey", "strength")


# Sequences

_ORDERED = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_id, (event_id * 31 + user_id * 7) % 256 AS b FROM events"


def _event_bytes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).alias("pos"), "event_id", ((F.col("event_id") * 31 + F.col("user_id") * 7) % 256).alias("b"))


for _stride in (1, 4):

    @add(f"delta_s{_stride}", f"SELECT event_id, ((b - coalesce(lag(b, {_stride}) OVER (PARTITION BY user_id ORDER BY pos), 0)) % 256 + 256) % 256 AS d FROM ({_ORDERED})")
    def _(spark: SparkSession, d: str, s: int = _stride) -> DataFrame:
        return sequence.delta(_event_bytes(spark, d), "user_id", "pos", "b", s).select("event_id", "d")


@add("undelta", f"SELECT event_id, b AS v FROM ({_ORDERED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Deltas of stride 4 and back; the bytes themselves are dropped in between."""
    coded = sequence.delta(_event_bytes(spark, d), "user_id", "pos", "b", 4).select("user_id", "pos", "event_id", "d")
    return sequence.undelta(coded, "user_id", "pos", "d", 4).select("event_id", "v")


@add(
    "transpose_s4",
    f"SELECT event_id, CASE WHEN n <= 4 THEN pos ELSE row_number() OVER (PARTITION BY user_id ORDER BY pos % 4, pos) - 1 END::INT AS out_pos FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ({_ORDERED}))",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.transpose(_event_bytes(spark, d), "user_id", "pos", 4).select("event_id", "out_pos")


@add("plane_delta", f"SELECT event_id, CASE WHEN p IS NULL THEN b ELSE ((b - p) % 256 + 256) % 256 END AS d FROM (SELECT event_id, b, lag(b) OVER (PARTITION BY user_id, pos % 4 ORDER BY pos) AS p FROM ({_ORDERED}))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.plane_delta(_event_bytes(spark, d), "user_id", "pos", "b", 4).select("event_id", "d")


@add("transitions", "SELECT before, after, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type AS after FROM events) WHERE before IS NOT NULL GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.transitions(table(spark, d, "events"), "user_id", "event_id", "event_type")


@add(
    "stride_runs",
    """WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, run::BIGINT AS run, event_type AS value, min(event_id) AS start, max(event_id) AS stop, count(*) AS n FROM g GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.runs(table(spark, d, "events"), "user_id", "event_id", "event_type")


_ITEM_RUNS = """WITH s AS (SELECT user_id AS stream, event_id AS pos, CASE event_type WHEN 'click' THEN 4 WHEN 'view' THEN 2 ELSE 0 END AS stride FROM events),
c AS (SELECT *, CASE WHEN stride IS DISTINCT FROM lag(stride) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c, lag(stride) OVER w AS b FROM s WINDOW w AS (PARTITION BY stream ORDER BY pos))"""


def _item_strides(spark: SparkSession, d: str) -> DataFrame:
    stride = F.when(F.col("event_type") == "click", 4).when(F.col("event_type") == "view", 2).otherwise(0)
    return table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("pos"), stride.alias("stride"))


@add(
    "boundary_hints",
    f"""{_ITEM_RUNS}
SELECT stream, pos AS byte_offset, CASE WHEN b > 0 THEN 'multimedia' ELSE 'binary' END AS content_before, CASE WHEN stride > 0 THEN 'multimedia' ELSE 'binary' END AS content_after,
       nullif(b, 0) AS stride_before, nullif(stride, 0) AS stride_after FROM c WHERE c = 1 AND b IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.boundary_hints(sequence.runs(_item_strides(spark, d), "stream", "pos", "stride"), "stream")


@add("end_report", f"{_ITEM_RUNS} SELECT stream, CASE WHEN sum(c) = 1 THEN 'uniform' ELSE 'varied' END AS verdict, sum(c)::BIGINT AS n_ranges FROM c GROUP BY stream")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.end_report(_item_strides(spark, d), "stream", "pos", "stride")


@add(
    "distance_slots",
    """SELECT l_orderkey, l_linenumber, slot::INT AS slot, (l_partkey - base)::BIGINT AS extra_value, CASE WHEN slot < 4 THEN 0 ELSE (slot - 2) // 2 END::INT AS extra_bits FROM (
  SELECT *, CASE WHEN slot < 4 THEN slot + 1 ELSE (1::BIGINT << (slot // 2)::INT) + CASE WHEN slot % 2 = 1 THEN 1::BIGINT << (slot // 2 - 1)::INT ELSE 0 END + 1 END AS base FROM (
    SELECT *, CASE WHEN l_partkey <= 4 THEN l_partkey - 1 ELSE 2 * t + ((l_partkey - 1) >> (t - 1)::INT) % 2 END AS slot
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, floor(log2(greatest(l_partkey - 1, 1)) + 1e-12)::BIGINT AS t FROM lineitem)))""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.distance_slot(F.col("l_partkey")).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


# Files, blocks, chunks, volumes

_FILES = "SELECT source || '/' || doc_id AS path, octet_length(encode(text)) AS size, text FROM documents"


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return tree.table_as_files(docs, F.concat_ws("/", "source", "doc_id"), F.col("text"))


@add("table_source", f"SELECT path, size, sha256(text) AS sha256 FROM ({_FILES})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return integrity.checksums(_files(spark, d), "content").select("path", "size", "sha256")


@add("buffer_source", "SELECT 'buffer' AS path, octet_length(encode(t)) AS size, sha256(t) AS sha256 FROM (SELECT r_name AS t FROM region WHERE r_regionkey = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    name = table(spark, d, "region").filter("r_regionkey = 0").first().r_name
    return integrity.checksums(tree.buffer_as_file(spark, name.encode()), "content").select("path", "size", "sha256")


@add("single_file_scan")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tree.read_files(spark, f"{d}/region.parquet").select("path", "entry_type", "size", F.sha2("content", 256).alias("sha256"))


@add("tree_scan")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tree.scan_tree(spark, d).select("path", "entry_type", "size", "target", "permissions")


@add(
    "similarity_sort",
    f"""SELECT path, row_number() OVER (PARTITION BY block_type ORDER BY ext NULLS FIRST, path) AS similarity FROM (
  SELECT lang || '/' || source || '.' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE 'binary' END AS block_type, doc_id::VARCHAR AS ext FROM documents)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "text").otherwise("binary")
    return grouping.similarity_rank(docs.select(F.concat(F.concat_ws("/", "lang", "source"), F.lit("."), F.col("doc_id")).alias("path"), kind.alias("block_type"))).select("path", "similarity")


@add(
    "pack_offsets",
    f"""SELECT path, size, (sum(size) OVER (PARTITION BY block_id ORDER BY size, path ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS block_offset
FROM (SELECT source || '/' || doc_id AS path, octet_length(encode(text)) AS size, doc_id % 7 AS block_id FROM documents)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).select("path", "size", (F.element_at(F.split("path", "/"), -1).cast("long") % 7).alias("block_id"))
    return grouping.block_offsets(files).select("path", "size", "block_offset")


def _packed(spark: SparkSession, d: str, capacity: int) -> DataFrame:
    c = profile.classify(_files(spark, d).select("path", "size", "content"), "content").select("path", "size", "block_type")
    return grouping.block_ids(grouping.pack_blocks(written(c), capacity))


_TYPED = "SELECT path, size, block_type, row_number() OVER (PARTITION BY block_type ORDER BY path) AS k FROM typed"
_FIRST_FIT = f"""
typed AS (SELECT d.source || '/' || d.doc_id AS path, octet_length(encode(d.text)) AS size,
            CASE WHEN pipeline = 'store_raw' THEN 'raw' WHEN content_type IN ('text', 'multimedia') THEN content_type ELSE 'binary' END AS block_type
          FROM documents d JOIN classes c ON c.doc_id = d.doc_id),
ordered AS ({_TYPED}),
folded AS (
  SELECT block_type, path, size, k, 1 AS bin, [greatest({64 << 10} - size, -1)] AS rooms FROM ordered WHERE k = 1
  UNION ALL
  SELECT block_type, path, size, k, bin, CASE WHEN bin > len(rooms) THEN list_append(rooms, greatest({64 << 10} - size, -1))
      ELSE list_transform(rooms, lambda r, i: CASE WHEN i = bin THEN r - size ELSE r END) END
  FROM (SELECT o.block_type, o.path, o.size, o.k, f.rooms,
               coalesce(nullif(list_position(list_transform(f.rooms, lambda r: r >= o.size), TRUE), 0), len(f.rooms) + 1) AS bin
        FROM folded f JOIN ordered o ON o.block_type = f.block_type AND o.k = f.k + 1)),
first_fit AS (SELECT path, size, block_type, (dense_rank() OVER (ORDER BY list_position(['text', 'multimedia', 'binary', 'raw', 'mixed'], block_type), bin) - 1)::BIGINT AS block_id FROM folded)
"""


@add("first_fit_blocks", f"WITH RECURSIVE {_BYTES}, {_ENTROPY}, {_CLASSES}, {_FIRST_FIT} SELECT path, size, block_type, block_id FROM first_fit")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, 64 << 10).select("path", "size", "block_type", "block_id")


@add("packed_totals", f"SELECT count(*) AS n_files, sum(size)::BIGINT AS n_bytes, 0::BIGINT AS n_over FROM ({_FILES})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All rows in are rows out; a block over its capacity holds one file only."""
    totals = grouping.block_totals(_packed(spark, d, 64 << 10), 64 << 10)
    return totals.agg(F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.count_if((F.col("n_bytes") > 64 << 10) & (F.col("n_files") > 1)).alias("n_over"))


_KIND_OF = "['text', 'multimedia', 'binary', 'raw', 'mixed'][1 + (key % 5)::INT]"


def _typed_rows(spark: SparkSession, d: str) -> DataFrame:
    """path, block_type: documents and pages, of a type by their number."""
    parts = (table(spark, d, "documents").select(F.lit("d").alias("_p"), F.col("doc_id").alias("key")), table(spark, d, "pages").select(F.lit("p"), "page_id"))
    kind = F.element_at(F.array(*map(F.lit, C.BLOCK_ORDER)), (F.col("key") % 5 + 1).cast("int"))
    return parts[0].union(parts[1]).select(F.concat("_p", F.col("key").cast("string")).alias("path"), "key", kind.alias("block_type"))


_TYPED_ROWS = f"SELECT p || key AS path, key, {_KIND_OF} AS block_type FROM (SELECT 'd' AS p, doc_id AS key FROM documents UNION ALL SELECT 'p', page_id FROM pages)"


@add(
    "group_union",
    f"SELECT path, block_type, row_number() OVER (ORDER BY list_position(['text', 'multimedia', 'binary', 'raw', 'mixed'], block_type), path)::BIGINT AS place FROM ({_TYPED_ROWS})",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all types in one sequence: text, multimedia, binary, raw, mixed."""
    rows = _typed_rows(spark, d).select("path", "block_type", C.block_rank(F.col("block_type")).alias("_rank"), F.lit(0).alias("_all"))
    return grouping.ranked(rows, "_all", [F.col("_rank").asc(), F.col("path").asc()], "place").select("path", "block_type", "place")


_FILTER_NAMES = "['audio_delta', 'bcj_x86', 'float_channel_split', 'float_split', 'none', 'rgb_split', 'rgba_delta', 'word_delta']"


@add(
    "context_allowed",
    f"""SELECT path, block_type IN ('text', 'binary', 'mixed') AND media_filter IN ('none', 'bcj_x86') AS allowed
FROM (SELECT *, {_FILTER_NAMES}[1 + (key % 8)::INT] AS media_filter FROM ({_TYPED_ROWS}))""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    media = F.element_at(F.array(*map(F.lit, sorted(X.FILTERS))), (F.col("key") % 8 + 1).cast("int"))
    return _typed_rows(spark, d).select("path", C.context_allowed(F.col("block_type"), media).alias("allowed"))


@add(
    "chunk_docs",
    """SELECT doc_id, k::INT AS chunk_no, sha256(substr(text, 1 + k * 1000, 1000)) AS sha256 FROM (
  SELECT doc_id, text, unnest(range(0, greatest((length(text) + 999) // 1000, 1))) AS k FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM documents))""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 1,000 bytes of the texts with all but printable ASCII replaced, so that bytes are characters."""
    docs = _docs(spark, d).withColumn("text", F.regexp_replace("text", "[^ -~]", "?"))
    return grouping.chunks_of(docs, "text", 1000).select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("sha256"))


@add(
    "range_join_chunk_file",
    f"""WITH f AS (SELECT path, size, doc_id % 7 AS block_id, sum(size) OVER (PARTITION BY doc_id % 7 ORDER BY size, path ROWS UNBOUNDED PRECEDING) - size AS o
  FROM (SELECT source || '/' || doc_id AS path, octet_length(encode(text)) AS size, doc_id FROM documents)),
b AS (SELECT block_id, sum(size) AS n FROM f GROUP BY block_id),
c AS (SELECT block_id, unnest(range(0, greatest((n + 4095) // 4096, 1)::BIGINT)) AS k FROM b)
SELECT c.block_id, c.k::INT AS chunk_no, f.path FROM c LEFT JOIN f ON f.block_id = c.block_id AND f.o <= c.k * 4096 AND c.k * 4096 < f.o + f.size""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).select("path", "size", (F.element_at(F.split("path", "/"), -1).cast("long") % 7).alias("block_id"))
    placed = grouping.block_offsets(files)
    sizes = placed.groupBy("block_id").agg(F.sum("size").alias("n"))
    return grouping.chunk_files(grouping.chunk_ranges(sizes, "n", 4096), placed).select("block_id", "chunk_no", "path")


@add(
    "volume_packing",
    f"""WITH RECURSIVE {_BYTES}, {_ENTROPY}, {_CLASSES}, {_FIRST_FIT},
sizes AS (SELECT block_id, sum(size)::BIGINT AS size FROM first_fit GROUP BY block_id),
placed AS (
  SELECT block_id, size, 1 AS volume_id, 50::BIGINT AS volume_offset FROM sizes WHERE block_id = 0
  UNION ALL
  SELECT s.block_id, s.size, CASE WHEN p.volume_offset + p.size + s.size > {256 << 10} THEN p.volume_id + 1 ELSE p.volume_id END,
         CASE WHEN p.volume_offset + p.size + s.size > {256 << 10} THEN 50 ELSE p.volume_offset + p.size END
  FROM placed p JOIN sizes s ON s.block_id = p.block_id + 1)
SELECT block_id, size, volume_id::INT AS volume_id, volume_offset, 50 + size > {256 << 10} AS oversize FROM placed""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    sizes = _packed(spark, d, 64 << 10).groupBy("block_id").agg(F.sum("size").alias("size"))
    return grouping.volumes(sizes, 256 << 10).select("block_id", "size", "volume_id", "volume_offset", "oversize")


@add(
    "volume_fold",
    """WITH RECURSIVE b AS (SELECT row_number() OVER (ORDER BY p_partkey) AS k, p_partkey AS block_id, (p_size * 1000)::BIGINT AS size FROM part),
f AS (
  SELECT k, block_id, size, 1 AS volume_id, 50::BIGINT AS volume_offset FROM b WHERE k = 1
  UNION ALL
  SELECT b.k, b.block_id, b.size, CASE WHEN f.volume_offset + f.size + b.size > 200000 THEN f.volume_id + 1 ELSE f.volume_id END,
         CASE WHEN f.volume_offset + f.size + b.size > 200000 THEN 50 ELSE f.volume_offset + f.size END FROM f JOIN b ON b.k = f.k + 1)
SELECT block_id, volume_id::INT AS volume_id, volume_offset FROM f""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "part").select(F.col("p_partkey").alias("block_id"), (F.col("p_size") * 1000).cast("long").alias("size"))
    return grouping.volumes(blocks, 200_000).select("block_id", "volume_id", "volume_offset")


_ORDER_VOLUMES = "SELECT o_orderkey AS block_id, (o_custkey % 9 + 1)::INT AS volume_id FROM orders"


@add("missing_volume_anti", f"SELECT block_id, volume_id FROM ({_ORDER_VOLUMES}) WHERE volume_id IN (2, 5)")
def _(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id"), (F.col("o_custkey") % 9 + 1).cast("int").alias("volume_id"))
    present = spark.createDataFrame([(v,) for v in range(1, 10) if v not in (2, 5)], "volume_id int")
    return grouping.missing_volumes(index, present).select("block_id", "volume_id")


@add(
    "block_volume_join",
    """SELECT volume_id, count(*) AS n_blocks, sum(o_custkey)::BIGINT AS n_bytes
FROM (SELECT l_orderkey AS block_id, (min(l_suppkey) % 9 + 1)::INT AS volume_id FROM lineitem GROUP BY l_orderkey) v JOIN orders o ON o.o_orderkey = v.block_id GROUP BY volume_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Blocks are orders (their size is the customer's number), the volume index is made from line items."""
    index = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("block_id")).agg((F.min("l_suppkey") % 9 + 1).cast("int").alias("volume_id"))
    blocks = table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id"), F.col("o_custkey").alias("size"))
    return blocks.join(index, "block_id").groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("size").alias("n_bytes"))


@add("metadata_volume", "SELECT s_nationkey::VARCHAR AS archive_id, CASE WHEN bool_or(v = 1) THEN 1 ELSE max(v) END::INT AS volume_id FROM (SELECT s_nationkey, (s_suppkey % 4 + 1)::INT AS v FROM supplier) GROUP BY s_nationkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("archive_id"), (F.col("s_suppkey") % 4 + 1).cast("int").alias("volume_id"))
    return grouping.metadata_volume(s)


# Integrity


@add("sha256_docs", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return integrity.checksums(_docs(spark, d), "text").select("doc_id", "sha256")


@add(
    "crc32_docs",
    f"""WITH RECURSIVE steps AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
rows AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ({_BYTE})::BIGINT) AS bytes FROM documents)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS crc32 FROM rows, crc_table""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return integrity.checksums(_docs(spark, d), "text").select("doc_id", "crc32")


@add("hex_docs", "SELECT doc_id, lower(hex(encode(text))) AS code FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(F.col("text").cast("binary"))).alias("code"))


@add("verify_status", "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'crc_mismatch' WHEN doc_id % 10 = 4 THEN 'not_found' ELSE 'ok' END AS status FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Stored checksums of which one in ten is of a changed text and one in ten is lost."""
    docs = _docs(spark, d)
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    stored = integrity.checksums(changed, "text").filter("doc_id % 10 <> 4").select("doc_id", "crc32", "sha256")
    return integrity.verify(docs, "doc_id", "text", stored)


# Round trips: the decoder sees the encoded columns only


def _digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.sha2("value", 256).alias("sha256"))


def _round_trip(name: str, stack: X.Stack, source: str = "documents", key: str = "doc_id", value: str = "text") -> None:
    @add(name, f"SELECT {key}, sha256({value}) AS sha256 FROM {source}")
    def _(spark: SparkSession, d: str) -> DataFrame:
        coded = codec.apply_transform(table(spark, d, source).select(key, value), value, stack)
        return _digest(codec.undo_transform(coded.select(key, "coded", "transform")), key)


_round_trip("rt_transpose", X.Stack(stride=4))
_round_trip("rt_bwt", X.Stack(bwt=True))
_round_trip("rt_float_split", X.Stack(filter="float_split"))
_round_trip("rt_float_channels", X.Stack(filter="float_channel_split", channels=3))
_round_trip("rt_audio", X.Stack(filter="audio_delta", channels=2, bit_depth=16))
_round_trip("rt_word_delta", X.Stack(filter="word_delta", channels=3, bit_depth=32))
_round_trip("rt_rgb", X.Stack(filter="rgb_split"))
_round_trip("rt_rgba", X.Stack(filter="rgba_delta"))
_round_trip("rt_bcj", X.Stack(filter="bcj_x86"), "pages", "page_id", "html")
_round_trip("rt_stack", X.Stack(stride=3, bwt=True, filter="bcj_x86"), "pages", "page_id", "html")

for _level in ("fast", "balanced"):

    @add(f"rt_lz77_{_level}", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
    def _(spark: SparkSession, d: str, level: str = _level) -> DataFrame:
        return _digest(codec.decode(codec.encode(_docs(spark, d), "text", level)))


@add("rt_lz77_optimal", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The optimal parse and the choice of BWT."""
    rows = _docs(spark, d).withColumn("kind", F.lit("text"))
    return _digest(codec.decode(codec.encode(rows, "text", "maximum", "kind")))


for _level in ("tiny", "extreme"):

    @add(f"rt_lz77_{_level}", "SELECT page_id, sha256(html) AS sha256 FROM pages")
    def _(spark: SparkSession, d: str, level: str = _level) -> DataFrame:
        return _digest(codec.decode(codec.encode(table(spark, d, "pages").select("page_id", "html"), "html", level)), "page_id")


@add("rt_rans", "SELECT conv_id, turn, sha256(text) AS sha256 FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    from loomstone.plans.kernels import rans_decode, rans_encode

    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return rans_decode(rans_encode(rows, "text")).select("conv_id", "turn", F.sha2("value", 256).alias("sha256"))


@add("rt_ppm", "SELECT item_id, sha256(text) AS sha256 FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _digest(contexts.ppm_decode(contexts.ppm_encode(table(spark, d, "benchmark").select("item_id", "text"), "text")), "item_id")


@add("rt_context_literals", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _digest(contexts.decode(contexts.encode(_docs(spark, d), "text")))


@add("rt_aes", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    kdf = crypto.Kdf("000102030405060708090a0b0c0d0e0f", n=1 << 12)
    key = kdf.key("a password for the test")
    plain = _docs(spark, d).select("doc_id", F.col("text").cast("binary").alias("value"))
    sealed = written(crypto.encrypt(plain, "value", key, kdf.salt, ["doc_id"]))
    return _digest(crypto.decrypt(sealed, "value", key, ["doc_id"]))


@add("rt_numeric_planes", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Doubles as bytes, delta and planes of stride 8, and back."""
    from loomstone.plans.kernels import doubles_round_trip

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return doubles_round_trip(rows, "l_quantity", ["l_orderkey", "l_linenumber"])


# Codec reports


@add(
    "freq_norm",
    f"""WITH {_BYTES}, counts AS (SELECT doc_id, b, count(*) AS c FROM doc_bytes GROUP BY doc_id, b),
shares AS (SELECT doc_id, b, c, sum(c) OVER (PARTITION BY doc_id) AS n FROM counts),
rounded AS (SELECT doc_id, b, greatest(floor((c::DOUBLE / n)::FLOAT * 4096::FLOAT + 0.5::FLOAT), 1)::BIGINT AS f FROM shares),
placed AS (SELECT doc_id, f, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, b DESC) AS k, sum(f) OVER (PARTITION BY doc_id) AS s FROM rounded),
fitted AS (SELECT doc_id, CASE WHEN k = 1 THEN greatest(1, f + 4096 - s) ELSE f END AS f FROM placed)
SELECT d.doc_id, coalesce(sum(f), 4096)::INT AS total, CASE WHEN count(f) = 0 THEN 256 ELSE count(f) END::INT AS symbols, coalesce(max(f), 16)::INT AS largest
FROM documents d LEFT JOIN fitted t ON t.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    from loomstone.plans.kernels import frequency_report

    return frequency_report(_docs(spark, d), "text")


@add("freq_norm_sums", "SELECT doc_id, 4096 AS total FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    from loomstone.plans.kernels import frequency_report

    return frequency_report(_docs(spark, d), "text").select("doc_id", "total")


@add("price_model")
def _(spark: SparkSession, d: str) -> DataFrame:
    return codec.token_summary(_docs(spark, d), "text", "fast")


@add("token_coverage", "SELECT doc_id, octet_length(encode(text)) AS covered FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Literals and bytes in matches make up the text."""
    t = codec.token_summary(_docs(spark, d), "text", "fast")
    return t.select("doc_id", (F.col("covered") + F.col("n_literals")).alias("covered"))


@add("stream_diagnostics")
def _(spark: SparkSession, d: str) -> DataFrame:
    return codec.stream_diagnostics(table(spark, d, "pages").select("html"), "html", "fast")


@add("codec_choice")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Values of all kinds, records and texts: raw, plain, by planes, by channels, with the program filter."""
    made = profile.classify(_made(spark, d), "value").select("p_partkey", F.coalesce(F.nullif("content_type", F.lit("incompressible")), F.lit("raw")).alias("kind"))
    made = _made(spark, d).join(made, "p_partkey").select("value", "kind")
    records = _records(spark, d).select("value", F.lit("multimedia").alias("kind"))
    docs = _docs(spark, d).select(F.col("text").cast("binary").alias("value"), F.lit("text").alias("kind"))
    coded = codec.encode(made.union(records).union(docs), "value", "fast", "kind")
    return coded.groupBy("codec", F.col("transform.filter").alias("filter")).agg(F.count(F.lit(1)).alias("n"), F.sum("raw_size").alias("raw_size"), F.sum(F.length("payload")).alias("coded_size"))


@add("raw_bypass", "SELECT count(*) AS n, 0::BIGINT AS differing FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Values of raw blocks are stored as they are."""
    docs = _docs(spark, d).withColumn("kind", F.lit("raw"))
    coded = codec.encode(docs, "text", "fast", "kind")
    both = coded.select("doc_id", "codec", F.sha2("payload", 256).alias("a")).join(_docs(spark, d).select("doc_id", F.sha2("text", 256).alias("b")), "doc_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("codec") != "raw") | (F.col("a") != F.col("b"))).alias("differing"))


@add("bcj_guard")
def _(spark: SparkSession, d: str) -> DataFrame:
    from loomstone.plans.kernels import bcj_report

    return bcj_report(table(spark, d, "pages").select("page_id", "html"), "html")


@add("context_decision")
def _(spark: SparkSession, d: str) -> DataFrame:
    return contexts.decide(table(spark, d, "benchmark").select("item_id", "text"), "text").select("item_id", "mode", "tables", F.round("single_bits", 3).alias("single_bits"))


@add("mixing_report")
def _(spark: SparkSession, d: str) -> DataFrame:
    return contexts.mixing_report(table(spark, d, "benchmark").select("item_id", "text"), "text").select("item_id", *(F.round(c, 3).alias(c) for c in ("mixed_bits", "ppm_bits", "ppm_weight", "neighbour_weight")))


# Archives


def _archive(spark: SparkSession, d: str, **options) -> archive.Reader:
    return _written_archive(spark, _files(spark, d), **options)


def _page_archive(spark: SparkSession, d: str, **options) -> archive.Reader:
    pages = table(spark, d, "pages")
    return _written_archive(spark, tree.table_as_files(pages, F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html")), F.col("html")), **options)


def _written_archive(spark: SparkSession, files: DataFrame, **options) -> archive.Reader:
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/loomstone/{uuid.uuid4().hex}"
    archive.write_archive(files, path, archive.Options(level="fast", **options))
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return archive.Reader(spark, path, options.get("password"))


@add("rt_container", f"SELECT path, sha256(text) AS sha256, 'ok' AS status FROM ({_FILES})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _archive(spark, d, chunk_size=64 << 10).read().select("path", F.sha2("content", 256).alias("sha256"), "status")


@add("rt_container_encrypted", f"SELECT path, sha256(text) AS sha256, 'ok' AS status FROM ({_FILES})")
def _(spark: SparkSession, d: str) -> DataFrame:
    got = _archive(spark, d, chunk_size=64 << 10, block_size=1 << 20, volume_size=256 << 10, password="a password for the test").read()
    return got.select("path", F.sha2("content", 256).alias("sha256"), "status")


@add("index_totals", f"SELECT count(*) AS n_files, sum(size)::BIGINT AS original_size FROM ({_FILES})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _archive(spark, d).info().select("n_files", "original_size")


@add("decompressed_size", "SELECT sum(octet_length(encode(html)))::BIGINT AS original_size FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _page_archive(spark, d).decompressed_size()


@add("archive_stats", "SELECT count(*) AS n_files, sum(octet_length(encode(html)))::BIGINT AS original_size, FALSE AS encrypted, TRUE AS smaller, 1.0::DOUBLE AS product FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The two ratios are reciprocals, and pages get smaller."""
    smaller = (F.col("compressed_size") < F.col("original_size")).alias("smaller")
    product = F.round(F.col("ratio_x") * F.col("size_fraction"), 9).alias("product")
    return _page_archive(spark, d).info().select("n_files", "original_size", "encrypted", smaller, product)


@add("healthy_volumes", "SELECT TRUE AS healthy, count(*) AS n_files FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All volumes of a set are healthy; the blocks in them hold all files."""
    a = _page_archive(spark, d, chunk_size=16 << 10, block_size=64 << 10, volume_size=48 << 10)
    files = a.index().groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    placed = a.table("volume_index").select("block_id", "volume_id").join(files, "block_id")
    return placed.join(a.volumes(), "volume_id").groupBy("healthy").agg(F.sum("n").alias("n_files"))


@add("list_paths", f"SELECT path FROM ({_FILES})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _archive(spark, d).list_files()


@add("path_lookup", f"SELECT path, size FROM ({_FILES}) WHERE path = (SELECT source || '/' || doc_id FROM documents WHERE doc_id = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "documents").filter("doc_id = 0").first().source
    return _archive(spark, d).find(f"{source}/0").select("path", "size")


@add("archive_verify", "SELECT 'ok' AS status, count(*) AS n FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _archive(spark, d, chunk_size=64 << 10).verify()


# Streams


@add("stream_stride_history")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A stream for each return flag: eight records of 16 bytes, the quantity plus 100 and zeros, for each line item, and bytes
    without a stride for the last quarter of the orders. So a stride is confirmed, windows cool down, and at last it drifts."""
    items = table(spark, d, "lineitem")
    late = F.col("l_orderkey") > items.agg(F.max("l_orderkey")).first()[0] * 3 // 4
    record = F.repeat(F.concat(F.lpad(F.hex(F.col("l_quantity").cast("int") + 100), 2, "0"), F.repeat(F.lit("00"), 15)), 8)
    noise = F.concat(*(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", F.lit(i)).cast("binary")) for i in range(8)))
    place = (F.col("l_orderkey") * 64 + F.col("l_linenumber")).cast("long").alias("offset")
    rows = items.select(F.col("l_returnflag").alias("stream_id"), place, F.unhex(F.when(late, noise).otherwise(record)).alias("data"))
    return streaming.stride_history_batch(rows)


_TURNS = "conv_id long, turn long, role string, text string"


@add("rt_stream_delta", "SELECT conv_id::VARCHAR AS stream_id, turn, sha256(text) AS sha256 FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a conversation are fragments of one stream: deltas carried from turn to turn, stored, and a second
    stream that undoes them. A null text is no fragment and has no digest."""
    turns = streaming.fragments_of(spark, d, "conversations", "conv_id", "text", _TURNS, stream=True, offset="turn")
    coded = streaming.stream_delta(turns, 4)
    again = spark.readStream.schema(coded.schema).parquet(streaming.run_to_folder(coded, spark))
    back = streaming.run_to_table(streaming.stream_delta(again, 4, back=True), spark)
    empty = table(spark, d, "conversations").filter("text IS NULL")
    return back.select("stream_id", F.col("offset").alias("turn"), F.sha2("data", 256).alias("sha256")).unionByName(
        empty.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").cast("long"), F.lit(None).cast("string").alias("sha256"))
    )
