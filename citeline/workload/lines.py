"""Registered queries: ordered-line operators over documents and events."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.functions.identifiers import collapse_spaces
from citeline.operators import lines as L, records as R
from citeline.operators.packing import pack_lines
from citeline.operators.scans import fill_forward, number_islands
from citeline.session import spread
from citeline.workload.common import SPACE_SQL, table

LINE_BLOCK = 1000


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = L.lines_of_text(spread(table(spark, sf, "documents")), "doc_id", "text")
    return lines.withColumn("page", F.floor(F.col("idx") / LINE_BLOCK).cast("int"))


LINES_CTE = f"""
lines as (select doc_id, unnest(string_split(text, chr(10))) as text,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx from documents),
normed as (select *, trim(regexp_replace(text, '{SPACE_SQL}+', ' ', 'g')) as norm from lines),
running as (select norm, count(distinct doc_id) as units from normed where norm <> '' group by norm having count(distinct doc_id) >= 3)
"""


def _running(lines: DataFrame) -> DataFrame:
    return L.repeated_texts(lines.where("norm <> ''"), [], "doc_id")


def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_lines(spark, sf).withColumn("norm", collapse_spaces(F.col("text")))
    return _running(lines)


REPEATED_SQL = f"with {LINES_CTE} select norm, units from running"


def strip_repeated(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_lines(spark, sf).withColumn("norm", collapse_spaces(F.col("text")))
    kept = lines.join(_running(lines).select("norm"), "norm", "left_anti")
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("text")).alias("chars"))


STRIP_SQL = f"""with {LINES_CTE}
select doc_id, count(*) as kept, sum(length(text))::bigint as chars from normed
where norm not in (select norm from running) group by doc_id"""


def chunk_split(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_lines(spark, sf).withColumn("cost", (F.length("text") + 1).cast("int"))
    packed = pack_lines(lines, ["doc_id"], "idx", "cost", L.MAX_CHARS)
    ready = packed.withColumns({
        "pos": F.col("idx"), "run": F.lit(0), "kind": F.lit("section"), "path": F.lit(""),
        "manual": F.col("doc_id").cast("string"),
    })
    chunks = L.assemble_chunks(ready.withColumn("doc_id", F.col("manual")))
    return chunks.select("id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


CHUNK_SQL = f"""with recursive {LINES_CTE},
packed as (
  select doc_id, idx, text, length(text) + 1 as size, 0 as piece from lines where idx = 0
  union all
  select l.doc_id, l.idx, l.text,
    case when p.size + length(l.text) + 1 > {L.MAX_CHARS} then length(l.text) + 1 else p.size + length(l.text) + 1 end,
    case when p.size + length(l.text) + 1 > {L.MAX_CHARS} then p.piece + 1 else p.piece end
  from packed p join lines l on l.doc_id = p.doc_id and l.idx = p.idx + 1),
pieces as (select doc_id, piece, regexp_replace(string_agg(text, chr(10) order by idx), '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') as text
  from packed group by doc_id, piece),
kept as (select *, row_number() over (partition by doc_id order by piece) - 1 as n from pieces where text <> '')
select doc_id || ':s' || lpad(n::varchar, 5, '0') as id, length(text) as chars, md5(text) as digest from kept"""


def user_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ordered rows of a user; a day bounds a block."""
    return table(spark, sf, "events").withColumn("day", F.to_date("ts"))


ORDER = ["ts", "event_id"]


def section_runs(spark: SparkSession, sf: str) -> DataFrame:
    events = user_events(spark, sf).select("user_id", "day", *ORDER, "event_type")
    runs = number_islands(
        events, ["user_id"], "day", ORDER, ["event_type"], lambda before: F.col("event_type") != before["event_type"],
        out="run", nth="nth",
    )
    return runs.select("event_id", "user_id", "event_type", "run", "nth")


RUNS_SQL = """with f as (select *, case when lag(event_type) over w is distinct from event_type then 1 else 0 end as opens
  from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(opens) over (partition by user_id order by ts, event_id) as run from f)
select event_id, user_id, event_type, run::bigint as run,
  row_number() over (partition by user_id, run order by ts, event_id) - 1 as nth from r"""


def asof_section(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the latest signup of its user at or before it."""
    events = user_events(spark, sf)
    marked = events.withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return fill_forward(marked, ["user_id"], "day", ORDER, {"section": "mark"}).select("event_id", "section")


ASOF_SQL = """with e as (select event_id, user_id, ts from events),
s as (select event_id as section, user_id, ts from events where event_type = 'signup')
select e.event_id, s.section from e asof left join s on e.user_id = s.user_id and e.ts >= s.ts"""


def asof_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Each order date of a customer with the outline entry in force: the customer's largest order so far by key."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).alias("page"),
        F.col("o_orderkey").alias("ord"), F.concat_ws(" ", "o_orderpriority", F.lit("(continued)")).alias("title"),
    )
    found = R.section_of_pages(orders, orders)
    return found.select(F.col("doc_id").alias("custkey"), "page", "section")


ASOF_OUTLINE_SQL = """with o as (select o_custkey as custkey, date_diff('day', date '1992-01-01', o_orderdate::date) as page,
    o_orderkey as ord, o_orderpriority as title from orders),
p as (select distinct custkey, page from o)
select custkey, page, coalesce((select arg_max(title, ord) from o where o.custkey = p.custkey and o.page <= p.page), '') as section from p"""


def block_records(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a user's events: a signup opens, a purchase closes; errors and views label what follows."""
    events = user_events(spark, sf)
    kind = F.col("event_type")
    label = F.when(kind == "error", F.lit("causes")).when(kind == "view", F.lit("remedies"))
    rows = R.split_blocks(events, kind == "signup", kind == "purchase", ["user_id"], "day", ORDER, label=label)
    return rows.groupBy("user_id", F.col("block_at.event_id").alias("block"), "field").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("total")
    )


BLOCKS_SQL = """with m as (select *, sum(case when event_type in ('signup', 'purchase') then 1 else 0 end) over w as island
  from events window w as (partition by user_id order by ts, event_id)),
b as (select *, first_value(event_type) over x as head, first_value(event_id) over x as block,
    last_value(case event_type when 'signup' then 'description' when 'error' then 'causes' when 'view' then 'remedies' end ignore nulls) over x as field
  from m window x as (partition by user_id, island order by ts, event_id))
select user_id, block, field, count(*) as n, round(sum(value::decimal(18,4)), 2)::double as total from b
where head = 'signup' group by all"""


def merged_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Values of error events read as merged cells: they take the value of the latest other event before them."""
    events = user_events(spark, sf).withColumn("own", F.when(F.col("event_type") != "error", F.struct("event_id", "value")))
    filled = fill_forward(events, ["user_id"], "day", ORDER, {"donor": "own"})
    return filled.select("event_id", F.col("donor.event_id").alias("donor"), F.col("donor.value").alias("value"))


FILL_SQL = """select event_id,
  last_value(case when event_type <> 'error' then event_id end ignore nulls) over w as donor,
  last_value(case when event_type <> 'error' then value end ignore nulls) over w as value
from events window w as (partition by user_id order by ts, event_id)"""


def assemble_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of every document; short lines carry a bullet."""
    bulleted = F.when(F.length("text") < 40, F.concat(F.lit("• "), F.col("text"))).otherwise(F.col("text"))
    lines = document_lines(spark, sf).withColumn("text", bulleted)
    items = R.assemble_items(lines, ["doc_id"], "page", ["idx"])
    return items.select("doc_id", "item_no", F.length("item").alias("chars"), F.md5("item").alias("digest"))


ITEMS_SQL = f"""with {LINES_CTE},
t as (select doc_id, idx, regexp_replace(case when length(text) < 40 then '• ' || text else text end,
    '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') as t from lines),
b as (select *, regexp_matches(t, '^[•●▪]') as bullet,
    regexp_replace(t, '^[•●▪]{SPACE_SQL}*', '') as body from t where t <> ''),
f as (select *, lag(body) over (partition by doc_id order by idx) as before from b),
i as (select *, sum(case when bullet or before is null or (regexp_matches(before, '[.:!?]$') and regexp_matches(body, '^\\p{{Lu}}'))
    then 1 else 0 end) over (partition by doc_id order by idx) as island from f),
g as (select doc_id, island, trim(regexp_replace(string_agg(body, ' ' order by idx), '{SPACE_SQL}+', ' ', 'g')) as item
  from i where body <> '' group by doc_id, island)
select doc_id, island::bigint as item_no, length(item) as chars, md5(item) as digest from g"""


def bbox_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Line items whose (quantity, price) point lies in the box of their part."""
    items = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("doc_id"), F.lit(1).alias("page"), "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("x0"), F.col("l_quantity").alias("x1"),
        F.col("l_extendedprice").alias("y0"), F.col("l_extendedprice").alias("y1"),
    )
    boxes = table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("p_size") - 10).cast("double").alias("bx0"),
        (F.col("p_size") + 10).cast("double").alias("bx1"), (F.col("p_retailprice") * 10).alias("by0"),
        (F.col("p_retailprice") * 60).alias("by1"),
    )
    return R.lines_in_boxes(items, boxes).select("l_orderkey", "l_linenumber", F.col("doc_id").alias("l_partkey"))


BBOX_SQL = """select l_orderkey, l_linenumber, l_partkey from lineitem join part on p_partkey = l_partkey
where l_quantity between p_size - 10 and p_size + 10 and l_extendedprice between p_retailprice * 10 and p_retailprice * 60"""


def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each normalised text, and how many later ones repeat it."""
    docs = table(spark, sf, "documents").select(
        F.md5(F.upper(collapse_spaces(F.col("text")))).alias("code_key"), F.lit("all").alias("manual_id"),
        F.col("doc_id").alias("ord"), F.col("source").alias("code"), F.col("doc_id").alias("page"),
    )
    firsts = R.dedupe_first(docs, ["manual_id", "code_key"], "ord")
    later = R.duplicate_notes(docs).groupBy("note").agg(F.count("*").alias("n"))
    kept = firsts.select(F.format_string("kept %s p%d", "code", "page").alias("note"), F.lit(1).cast("long").alias("n"))
    return kept.unionByName(later)


DEDUPE_SQL = f"""with d as (select doc_id, source, md5(upper(trim(regexp_replace(text, '{SPACE_SQL}+', ' ', 'g')))) as k from documents),
r as (select *, first_value(doc_id) over (partition by k order by doc_id) as f from d)
select 'kept ' || source || ' p' || doc_id as note, 1::bigint as n from r where doc_id = f
union all
select source || ' (p' || doc_id || ', first seen p' || f || ')' as note, count(*) as n from r where doc_id <> f group by 1"""


QUERIES = {
    "repeated_lines": (repeated_lines, REPEATED_SQL),
    "strip_repeated": (strip_repeated, STRIP_SQL),
    "chunk_split": (chunk_split, CHUNK_SQL),
    "section_runs": (section_runs, RUNS_SQL),
    "asof_section": (asof_section, ASOF_SQL),
    "asof_outline": (asof_outline, ASOF_OUTLINE_SQL),
    "block_records": (block_records, BLOCKS_SQL),
    "merged_fill": (merged_fill, FILL_SQL),
    "assemble_items": (assemble_items, ITEMS_SQL),
    "bbox_semi": (bbox_semi, BBOX_SQL),
    "dedupe_first": (dedupe_first, DEDUPE_SQL),
}
