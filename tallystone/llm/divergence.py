"""Source divergence audit: which sources of a language use its terms differently, and which terms mark a source.

DuckDB counts the terms of bounded slices of texts inside the tasks that read
them; Spark adds the counts up and deals them into shards by a hash of
language and term. In every shard DuckDB finds the language's kept terms, sums
the differences of pairs of sources, and ranks each source's own terms; Spark
merges the shards' sums and rankings.

The smoothed share of a term is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), so
every term a source lacks has the same share p0. A pair's value is therefore
V |p0a - p0b|, corrected by each source's own terms against the other's p0 (from
the numbers of its equal shares) and by the terms both hold (the shards' pair
sums). Work grows with the terms that sources hold, not with sources times
vocabulary. All sums are of whole numbers.

Defined cases: null text, lang and source are empty texts; a document without
terms still makes its group appear; a language without kept terms gives its
pairs the value 0 and no terms; repeated rows are documents of their own; an
empty table gives no rows; a language of one source has no pairs; extra columns
are left out, whatever their names; very long texts are counted whole, in a slice
of their own.
"""

from __future__ import annotations

import string
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import saved

LEAST_DOCS, SCALE, SMOOTH, TOP = 30, 1_000_000_000, 5, 50
#: Bytes of text that DuckDB counts at once, and rows of counts in a shard.
SLICE_BYTES, SHARD_ROWS = 8 << 20, 400_000
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def connection():
    """An in-memory DuckDB of one thread; what does not fit goes to the executor's scratch folder while a query runs."""
    import duckdb

    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute("set preserve_insertion_order = false")
    con.execute("set memory_limit = '600MB'")
    con.execute(f"set temp_directory = '{tempfile.gettempdir()}/duckdb-spill'")
    return con


def _runs(sizes: list[int], limit: int):
    """(offset, length) of runs of rows of bounded bytes; a larger row is a run of its own."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i - at
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes) - at


def _typed(table: pa.Table, schema: pa.Schema) -> list[pa.RecordBatch]:
    return table.cast(schema).combine_chunks().to_batches(max_chunksize=50_000)


COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNT_SQL = f"""
select lang, source, term, sum(n)::bigint as n, count(*) as docs from (
  select id, lang, source, term, count(*) as n
  from (select id, lang, source, unnest(string_split_regex(text, '{SEPARATORS}')) as term from slice)
  where term <> '' group by id, lang, source, term)
group by lang, source, term
"""


def term_counts(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents), counted over whole texts."""

    def run(batches):
        con = connection()
        for batch in batches:
            for at, rows in _runs(pc.binary_length(batch.column("text")).to_pylist(), SLICE_BYTES):
                part = batch.slice(at, rows)
                columns = {"id": pa.array(range(rows), pa.int64()), "lang": part.column("lang"), "source": part.column("source"), "text": pc.ascii_lower(part.column("text"))}
                con.register("slice", pa.table(columns))
                yield from _typed(con.sql(COUNT_SQL).to_arrow_table(), COUNTS)
                con.unregister("slice")
        con.close()

    read = documents.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    partial = read.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_lang", pa.int64())])
KEPT_SQL = """
select c.lang, c.source, c.term, c.n, k.n_lang from counts c
join (select lang, term, sum(n)::bigint as n_lang from counts group by lang, term having sum(docs) >= {least}) k on k.lang = c.lang and k.term = c.term
"""

#: kind: 'pair' a correction for terms that both sources hold, 'share' how often a source has one share, 'term' a source's leading terms.
FOUND = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("p", pa.int64()), ("value", pa.int64())])
SHARE_SQL = """
create or replace temp table shares as select lang, source, term, p0,
(1 + {scale}::hugeint * (n + {smooth}) // (total + {smooth} * v))::bigint as p,
(1 + {scale}::hugeint * (n_lang + {smooth}) // (total_lang + {smooth} * v))::bigint as q from held
"""
FOUND_SQL = """
select 'pair' as kind, a.lang, a.source, b.source as item, 0 as p,
sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(a.p0 - b.p) + abs(a.p0 - b.p0))::bigint as value
from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all
union all select 'share', lang, source, '', p, count(*) from shares group by all
union all select 'term', lang, source, term, 0, p - q from shares where p > q
qualify row_number() over (partition by lang, source order by p - q desc, term) <= {top}
"""


def _by_shard(rows: DataFrame, shards: int, schema: pa.Schema, statements: list[str], table: str) -> DataFrame:
    """Run SQL over every shard of ``rows``, dealt by a hash of lang and term; the last statement's rows are the result."""
    names = rows.columns

    def run(batches):
        con, held = connection(), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            con.register("incoming", pa.table(dict(zip(names, batch.columns, strict=True))))
            con.execute(f"insert into {table} select * from incoming" if held else f"create temp table {table} as select * from incoming")
            con.unregister("incoming")
            held = True
        if held:
            for statement in statements[:-1]:
                con.execute(statement)
            yield from _typed(con.sql(statements[-1]).to_arrow_table(), schema)
        con.close()

    kinds = {pa.string(): T.StringType(), pa.int64(): T.LongType()}
    return rows.repartition(shards, "lang", "term").mapInArrow(run, T.StructType([T.StructField(f.name, kinds[f.type]) for f in schema]))


def _shards(rows: DataFrame) -> int:
    at_least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(at_least, -(-rows.count() // SHARD_ROWS))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank of every pair and leading term."""
    counts = saved(term_counts(documents, text, lang, source), "divergence-counts")
    kept = saved(_by_shard(counts, _shards(counts), KEPT, [KEPT_SQL.format(least=least_docs)], "counts"), "divergence-kept")

    per_lang = kept.groupBy("lang", "term").agg(F.max("n_lang").alias("n")).groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count(F.lit(1)).alias("v"))
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = documents.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]).distinct()
    groups = groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["total", "total_lang", "v"])
    below = F.col("total") + SMOOTH * F.col("v")
    p0 = F.when(below > 0, 1 + F.expr(f"{SCALE * SMOOTH}L div (total + {SMOOTH} * v)")).otherwise(F.lit(0).cast("long"))
    groups = saved(groups.withColumn("p0", p0), "divergence-groups")

    held = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "n_lang", "total", "total_lang", "v", "p0")
    found = _by_shard(held, _shards(kept), FOUND, [SHARE_SQL.format(scale=SCALE, smooth=SMOOTH), FOUND_SQL.format(top=top)], "held")
    found = saved(found, "divergence-found")

    a, b = groups.select("lang", "source", "v", "p0"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("p0_item"))
    gap = F.abs(F.col("p0") - F.col("p0_item"))
    base = a.join(b, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * gap).alias("value"))
    shares = found.where("kind = 'share'").groupBy("lang", "source", "p").agg(F.sum("value").alias("terms"))
    shares = shares.join(a.drop("v"), ["lang", "source"])
    own = shares.join(b, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (F.abs(F.col("p") - F.col("p0_item")) - gap)).alias("value"))
    both = found.where("kind = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = own.unionByName(both)
    turned = sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(sums).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    terms = ranked(found.where("kind = 'term'").select("lang", "source", "item", "value"), "term").where(F.col("rank") <= top)
    return ranked(pairs, "pair").unionByName(terms)


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns over whole texts."""
    return audit(documents)


def oracle() -> str:
    """DuckDB SQL over the dense table of groups and kept terms."""
    return f"""with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select id, lang, source, translate(unnest(regexp_extract_all(text, '{TERMS}')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as term from d),
kept as (select lang, term from w group by lang, term having count(distinct id) >= {LEAST_DOCS}),
lang_v as (select lang, count(*) as v from kept group by lang),
n as (select w.lang, w.source, w.term, count(*) as n from w join kept k on k.lang = w.lang and k.term = w.term group by all),
g as (select distinct lang, source from d),
dense as (select g.lang, g.source, k.term, coalesce(n.n, 0) as n from g join kept k on k.lang = g.lang left join n on n.lang = g.lang and n.source = g.source and n.term = k.term),
p as (select x.lang, source, term, n, (1 + {SCALE}::hugeint * (n + {SMOOTH}) // (sum(n) over (partition by x.lang, source) + {SMOOTH} * v))::bigint as p from dense x join lang_v using (lang)),
q as (select x.lang, term, (1 + {SCALE}::hugeint * (n + {SMOOTH}) // (sum(n) over (partition by x.lang) + {SMOOTH} * v))::bigint as q
from (select lang, term, sum(n) as n from dense group by lang, term) x join lang_v using (lang)),
diff as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
left join diff f on f.lang = a.lang and f.source = a.source and f.item = b.source),
term as (select p.lang, source, 'term' as part, p.term as item, p - q as value from p join q on q.lang = p.lang and q.term = p.term where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (from pair union all from term))
select * from ranked where part = 'pair' or rank <= {TOP}"""
