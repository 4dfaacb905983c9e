"""How far the sources of a language differ in their terms, and by which.

Tasks count terms with DuckDB; the counts are dealt into shards by a hash of language and term, so a shard knows everything about its terms.
In each shard SQL drops rare terms, later sums the divergence of each pair of sources over the shard's terms and ranks terms. Spark adds the
sums of the shards and ranks what they give.

A pair's sum runs over all kept terms of the language, also those that neither source has. These all add the same, so a shard sums only what its
terms add beyond that: what a term of one source adds (by count, as many terms share one), corrected for terms of both.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import durable
from ._text import release, slices, small_batches

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SLICE = 8 << 20  # bytes of text that one query counts
SHARD = 500_000  # counts of a shard, about
HELD = 1_000_000  # counts that a task gathers before it hands them on

COUNTS = "lang string, source string, term string, n long, docs long"
_COUNTED = f"""
with d as (select lang, source, row_number() over () as i, regexp_extract_all(text, '{TERM}') as terms from texts),
t as (select lang, source, i, unnest(terms) as term from d),
p as (select lang, source, term, i, count(*) as n from t group by all)
select lang, source, term, sum(n)::bigint as n, count(*) as docs from p group by all
union all select distinct lang, source, '', 0, 0 from d
"""
_MERGED = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from counts group by all"
_KEPT = f"""
with c as ({_MERGED}), often as (select lang, term from c group by all having sum(docs) >= {{least}} and term <> '')
select c.* from c semi join often using (lang, term) union all select * from c where term = ''
"""


def _p(n: str, total: str, v: str) -> str:
    return f"(1 + (1000000000::hugeint * ({n} + 2)) // nullif({total} + 2 * {v}, 0))::bigint"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"


_PAIRS = f"""
with g as (select lang, source, v, total, {_p("0", "total", "v")} as p0 from totals where source is not null),
k as (select c.lang, c.source, c.term, c.n, g.p0, {_p("c.n", "g.total", "g.v")} as p from counts c join g using (lang, source) where c.term <> ''),
alike as (select lang, source, p, p0, count(*) as m from k group by all),
added as (
  select lang, least(a.source, b.source) as a, greatest(a.source, b.source) as b, a.m * ({_f("a.p", "b.p0")} - {_f("a.p0", "b.p0")})::hugeint as x from alike a join g b using (lang) where a.source <> b.source
  union all
  select lang, x.source, y.source, {_f("x.p", "y.p")} - {_f("x.p", "y.p0")} - {_f("x.p0", "y.p")} + {_f("x.p0", "y.p0")} from k x join k y using (lang, term) where x.source < y.source
  union all
  select lang, x.source, y.source, x.v::hugeint * coalesce({_f("x.p0", "y.p0")}, 0) from g x join g y using (lang) where x.source < y.source and hash(lang, x.source, y.source) % {{shards}} = {{shard}})
select 'pair' as part, lang, a as source, b as item, sum(x)::bigint as value from added group by all
"""
_TERMS = f"""
with g as (select lang, source, v, total from totals),
q as (select c.lang, c.term, {_p("sum(c.n)", "any_value(l.total)", "any_value(l.v)")} as q from counts c join g l on l.lang = c.lang and l.source is null where c.term <> '' group by all),
k as (select c.lang, c.source, c.term, {_p("c.n", "g.total", "g.v")} as p, q.q from counts c join g using (lang, source) join q using (lang, term) where c.n > 0)
select 'term' as part, lang, source, term as item, {_f("p", "q")} as value from k where p > q qualify row_number() over (partition by lang, source order by value desc, term) <= {{top}}
"""


def _run(sql: str, **tables) -> pa.Table:
    """What the query gives over Arrow tables (or readers), on one thread in memory."""
    import duckdb

    with duckdb.connect(":memory:", config={"threads": 1}) as con:
        for name, table in tables.items():
            con.register(name, table)
        return con.sql(sql).to_arrow_table()


def _batches(table: pa.Table, schema: pa.Schema) -> Iterable[pa.RecordBatch]:
    return table.cast(schema).to_batches(max_chunksize=100_000)


_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_RESULT = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of parts of ``docs``: occurrences and documents with the term; each group has a row of the empty term.

    One (lang, source, term) can have several rows, which add up.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            text = batch.column(2)
            for a, b in slices(text, SLICE):
                texts = pa.table({"lang": batch.column(0).slice(a, b - a), "source": batch.column(1).slice(a, b - a), "text": pc.ascii_lower(text.slice(a, b - a))})
                held.append(_run(_COUNTED, texts=texts).cast(_ARROW))
                if sum(t.num_rows for t in held) > HELD:
                    merged = _run(_MERGED, counts=pa.concat_tables(held))
                    held = [merged.cast(_ARROW)]
                    if merged.num_rows > HELD // 2:
                        yield from _batches(merged, _ARROW)
                        held = []
        if held:
            yield from _batches(_run(_MERGED, counts=pa.concat_tables(held)), _ARROW)
        held.clear()
        release()

    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*blank).mapInArrow(count, COUNTS)


def kept_counts(docs: DataFrame, least: int = 10) -> DataFrame:
    """(lang, source, term, n) of the terms that ``least`` documents of their language have, and of the empty term of each group (n: 0)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_run(_KEPT.format(least=int(least)), counts=pa.RecordBatchReader.from_batches(_ARROW, (b.cast(_ARROW) for b in batches))), _ARROW)
        release()

    return term_counts(docs).repartition("lang", "term").mapInArrow(keep, COUNTS).drop("docs")


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language its distance from each other one ('pair') and its ``top`` marked terms ('term').

    Null lang, source and text are empty ones; a repeated row is a document of its own; other columns are ignored; groups without
    terms have pairs; a language without kept terms has pairs of value 0; an empty table gives no rows. Ranks go by value, then by the item's bytes.
    """
    kept = durable(kept_counts(docs, least))
    v = kept.where("term <> ''").select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = groups.groupBy("lang").agg(F.lit(None).cast("string").alias("source"), F.sum("total").alias("total"))
    shards = -(-kept.count() // SHARD) or 1  # by the number of counts, as each shard gives a row per pair of sources
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    totals = groups.unionByName(whole).join(v, "lang", "left").select(F.col("lang").alias("lang"), F.col("source").alias("source"), "total", F.coalesce("v", F.lit(0)).alias("v"), each)
    counts = kept.withColumn("shard", F.expr(f"cast(pmod(xxhash64(lang, term), {shards}) as int)"))

    def shares(key: tuple, counts: pa.Table, totals: pa.Table) -> pa.Table:
        tables = {"counts": counts, "totals": totals}
        out = [_run(_PAIRS.format(shards=shards, shard=key[0].as_py()), **tables), _run(_TERMS.format(top=int(top)), **tables)]
        release()
        return pa.concat_tables(t.cast(_RESULT) for t in out)

    shared = counts.groupBy("shard").cogroup(totals.groupBy("shard")).applyInArrow(shares, "part string, lang string, source string, item string, value long")
    shared = durable(shared)
    pairs = shared.where("part = 'pair'").groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("part", "lang", "value", F.explode(F.expr("array(struct(source, item), struct(item as source, source as item))")).alias("e")).select("part", "lang", "e.source", "e.item", "value")
    rank = F.row_number().over(Window.partitionBy("part", "lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.unionByName(shared.where("part = 'term'")).withColumn("rank", rank)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


_SQL_P, _SQL_F = "(1 + (1000000000::hugeint * (n + 2)) // (total + 2 * v))::bigint", "(({0} - {1}) * ({0} - {1}) // ({0} + {1}))"

SQL = rf"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as i, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select lang, source, i, unnest(regexp_extract_all(t, '{TERM}')) as term from d),
kept as (select lang, term from w group by all having count(distinct i) >= 10),
vs as (select lang, count(*) as v from kept group by all),
groups as (select distinct lang, source from d),
found as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
cells as (select g.lang, g.source, k.term, coalesce(f.n, 0) as n from groups g join kept k using (lang) left join found f on f.lang = g.lang and f.source = g.source and f.term = k.term),
dense as (select lang, source, term, n, {_SQL_P} as p from (select c.*, sum(n) over (partition by lang, source) as total, v from cells c join vs using (lang))),
langs as (select lang, term, {_SQL_P} as q from (select lang, term, n, sum(n) over (partition by lang) as total, v from (select lang, term, sum(n) as n from cells group by all) join vs using (lang))),
sums as (select x.lang, x.source, y.source as item, sum({_SQL_F.format("x.p", "y.p")}) as value from dense x join dense y using (lang, term) where x.source <> y.source group by all),
pairs as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(s.value, 0)::bigint as value from groups g join groups h on g.lang = h.lang and g.source <> h.source left join sums s on s.lang = g.lang and s.source = g.source and s.item = h.source),
terms as (select lang, source, 'term' as part, term as item, {_SQL_F.format("p", "q")}::bigint as value from dense join langs using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms) qualify part = 'pair' or rank <= 10
"""
