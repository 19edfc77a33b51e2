"""Job data derived from the benchmark tables: plain SQL that Spark and DuckDB share."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# The fixed present of all queries that need one.
NOW = "1998-06-20 00:00:00"

VIEWS = {
    "jobs": """
select lpad(cast(o_orderkey as string), 32, '0') as guid,
  'rec' || cast(o_orderkey as string) || case o_orderkey % 5 when 0 then '.mp3' when 1 then '.wav'
    when 2 then '.tar.gz' when 3 then '' else '.M4A' end as filename,
  case when o_orderstatus = 'O' then 'pending' when o_orderstatus = 'P' then 'processing'
    when o_orderkey % 5 = 1 then 'error' when o_orderkey % 5 = 2 then 'quarantined'
    when o_orderkey % 5 = 3 then 'processed' else 'completed' end as status,
  cast(o_orderdate as timestamp) as created_at,
  o_totalprice / 100.0 as duration_sec,
  cast(ceil(o_totalprice / 100.0 / 15.1) * 5 + 45 as bigint) as processing_time_est,
  cast(o_orderkey % 3 as int) as attempt_count
from orders""",
    "submissions": """
select c_custkey as arrival, c_custkey % 11 <> 0 as has_file,
  case when c_custkey % 13 = 0 then '' else 'up' || cast(c_custkey as string) || '.mp3' end as filename,
  case c_custkey % 7 when 0 then null when 1 then 'not-a-guid'
    when 2 then lpad(cast(c_custkey as string), 32, '0')
    when 3 then '{' || lpad('a' || cast(c_custkey as string), 32, '0') || '}'
    else lpad('b' || cast(c_custkey % 50 as string), 32, '0') end as guid,
  abs(c_acctbal) as duration_sec
from customer""",
    "segments": """
select lpad(cast(conv_id as string), 32, '0') as guid, cast(turn as int) as seg_index,
  role as speaker, text,
  (sum(length(text)) over (partition by conv_id order by turn) - length(text)) * 6.25e-2 as seg_start,
  sum(length(text)) over (partition by conv_id order by turn) * 6.25e-2 as seg_end
from conversations""",
    "aligned_words": """
select s.guid,
  cast(row_number() over (partition by s.guid order by s.seg_index, n.n_nationkey) as int) as word_index,
  s.seg_start + n.n_nationkey * 7.5e-1 as word_start, s.seg_start + n.n_nationkey * 7.5e-1 + 5e-1 as word_end,
  'w' || cast(n.n_nationkey as string) as word
from segments s cross join nation n where (s.seg_index + n.n_nationkey) % 3 <> 0 and s.seg_index % 4 <> 3""",
    "words": """
select lpad(cast(user_id as string), 32, '0') as guid,
  case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as pass_index,
  cast(event_id % 7 as int) as seg_index, event_id as word_index,
  (event_id % 7) * 10e0 as seg_start, (event_id % 7) * 10e0 + 10e0 as seg_end,
  case when event_id % 9 = 0 then null else (event_id % 7) * 10e0 + (event_id % 32) * 2.5e-1 end as word_start,
  case when event_id % 23 = 0 then null else (event_id % 7) * 10e0 + (event_id % 32) * 2.5e-1 + (event_id % 5) * 2.5e-1 end as word_end,
  case when event_id % 17 = 0 then null when event_id % 19 = 0 then 0e0 else least(value / 4e2, 1e0) end as probability
from events""",
    "durations": """
select distinct lpad(cast(user_id as string), 32, '0') as guid, (user_id % 4) * 6e0 as duration_sec from events""",
    "turns": """
select guid, speaker, seg_start, seg_end from segments where seg_index % 5 <> 4 and (speaker = 'user' or guid not like '%3')""",
    "diarized": """
select distinct lpad(cast(conv_id as string), 32, '0') as guid, conv_id % 10 <> 0 as diarized from conversations""",
    "job_events": """
select lpad(cast(user_id * 97 + event_id % 40 as string), 32, '0') as guid, event_id as seq, cast(ts as timestamp) as ts,
  case when event_type = 'error' then 'garbage' when event_type = 'purchase' and event_id % 3 = 0 then 'completed'
    when event_type = 'purchase' then 'error' when event_type = 'click' then 'recovered'
    when event_type = 'view' then 'started' else 'submitted' end as outcome
from events""",
    "frames": """
select lpad(cast(vec_id % 50 as string), 32, '0') as guid, vec_id as seq, 16000 as sample_rate, embedding as samples from embeddings""",
    "listing": """
select guid, 'original' as kind from jobs where attempt_count <> 1
union all select guid, 'processed' as kind from jobs where processing_time_est % 2 = 0""",
    # One copy of the segments per recogniser pass; each pass misses other segments.
    "pass_segments": """
select s.guid, cast(p.pass_index as int) as pass_index, s.seg_index, s.seg_start, s.seg_end, s.text
from segments s cross join (values (0), (1), (2), (3), (4)) as p(pass_index)
where (s.seg_index + p.pass_index) % 6 <> 0""",
}

USES = {
    "aligned_words": ("segments",),
    "turns": ("segments",),
    "listing": ("jobs",),
    "pass_segments": ("segments",),
}


def with_views(sql: str, *names: str) -> str:
    """`sql` below the definitions of the views it names, for any engine that has the
    benchmark tables."""
    ordered: list[str] = []
    for name in names:
        for needed in (*USES.get(name, ()), name):
            if needed not in ordered:
                ordered.append(needed)
    parts = [f"{name} as ({VIEWS[name].strip()})" for name in ordered]
    return f"with {', '.join(parts)} {sql.strip()}" if parts else sql.strip()


# Three of the views number or add up the rows of a conversation. Spark builds these
# from chunks of it, since one conversation may hold a large part of all rows.

CHUNK_BITS = 12


def _sum_before(df: DataFrame, group: str, order: str, value: Column, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the group with a smaller `order`."""
    rows = df.withColumn("chunk", F.shiftright(order, CHUNK_BITS)).withColumn("value", value)
    by_chunk = Window.partitionBy(group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    in_chunk = Window.partitionBy(group, "chunk").orderBy(order)
    in_chunk = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(group, "chunk").agg(F.sum("value").alias("total"))
    chunks = chunks.select(
        group, "chunk", F.coalesce(F.sum("total").over(by_chunk), F.lit(0)).alias("earlier")
    )
    before = F.coalesce(F.sum("value").over(in_chunk), F.lit(0))
    return (
        rows.withColumn("before", before)
        .join(chunks, [group, "chunk"])
        .withColumn(out, F.col("earlier") + F.col("before"))
        .drop("chunk", "value", "before", "earlier")
    )


def _segments(i: "Inputs") -> DataFrame:
    turns = _sum_before(i.table("conversations"), "conv_id", "turn", F.length("text"), "chars")
    return turns.select(
        F.lpad(F.col("conv_id").cast("string"), 32, "0").alias("guid"),
        F.col("turn").cast("int").alias("seg_index"),
        F.col("role").alias("speaker"),
        "text",
        (F.col("chars") * 0.0625).alias("seg_start"),
        ((F.col("chars") + F.length("text")) * 0.0625).alias("seg_end"),
    )


def _aligned_words(i: "Inputs") -> DataFrame:
    numbers = F.filter(
        F.sequence(F.lit(0), F.lit(24)), lambda n: (F.col("seg_index") + n) % 3 != 0
    )
    spoken = i.view("segments").select("guid", "seg_index", "seg_start")
    spoken = spoken.where(F.col("seg_index") % 4 != 3)
    spoken = _sum_before(spoken, "guid", "seg_index", F.size(numbers), "words_before")
    start = F.col("seg_start") + F.col("n") * 0.75
    return spoken.select("*", F.posexplode(numbers).alias("pos", "n")).select(
        "guid",
        (F.col("words_before") + F.col("pos") + 1).cast("int").alias("word_index"),
        start.alias("word_start"),
        (start + 0.5).alias("word_end"),
        F.concat(F.lit("w"), F.col("n").cast("string")).alias("word"),
    )


def _turns(i: "Inputs") -> DataFrame:
    heard = (F.col("speaker") == "user") | ~F.col("guid").like("%3")
    segments = i.view("segments").where((F.col("seg_index") % 5 != 4) & heard)
    return segments.select("guid", "speaker", "seg_start", "seg_end")


def _pass_segments(i: "Inputs") -> DataFrame:
    passes = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pass_index")
    rows = i.view("segments").select("*", passes)
    return rows.where((F.col("seg_index") + F.col("pass_index")) % 6 != 0).select(
        "guid", "pass_index", "seg_index", "seg_start", "seg_end", "text"
    )


SPARK_VIEWS = {
    "segments": _segments,
    "aligned_words": _aligned_words,
    "turns": _turns,
    "pass_segments": _pass_segments,
}


class Inputs:
    """The benchmark tables of a folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table as a stream: of its part files where it is a folder, else of the one file."""
        table = self.table(name)
        reader = self.spark.readStream.schema(table.schema)
        path = f"{self.folder}/{name}.parquet"
        if any(not f.rstrip("/").endswith(f"/{name}.parquet") for f in table.inputFiles()):
            return reader.parquet(path)
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)

    def view(self, name: str) -> DataFrame:
        if name in SPARK_VIEWS:
            return SPARK_VIEWS[name](self)
        return self._over(name, {t: self.table(t) for t in self._tables(name)})

    def stream_view(self, name: str) -> DataFrame:
        return self._over(name, {t: self.stream(t) for t in self._tables(name)})

    def _tables(self, name: str) -> list[str]:
        words = set(re.findall(r"\w+", with_views("", name)))
        return [t for t in TABLES if t in words]

    def _over(self, name: str, tables: dict[str, DataFrame]) -> DataFrame:
        # Own names for the tables, so that no view of the session is touched.
        prefix = f"voxtab_{abs(hash((self.folder, name)))}"
        binds = []
        for table, df in tables.items():
            df.createOrReplaceTempView(f"{prefix}_{table}")
            binds.append(f"{table} as (select * from {prefix}_{table})")
        views = with_views(f"select * from {name}", name)
        views = views.removeprefix("with ")
        df = self.spark.sql(f"with {', '.join(binds)}, {views}")
        for table in tables:
            self.spark.catalog.dropTempView(f"{prefix}_{table}")
        return df
