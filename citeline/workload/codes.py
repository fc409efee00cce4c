"""Registered queries: identifiers, look-alikes, detection and audits over derived codes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.functions.identifiers import code_key, code_like_tokens
from citeline.operators import audit, evaluate, lexicon, search, triage
from citeline.session import spread
from citeline.workload.common import CODE_SQL, code_of, table

IS_CODE_SQL = """(length({t}) >= 2 and regexp_matches({t}, '[A-Za-z]') and (
  length(regexp_replace({t}, '[^A-Z]', '', 'g')) >= 2
  or (length(regexp_replace({t}, '[^A-Z]', '', 'g')) = 1 and not regexp_matches({t}, '^[A-Z]'))
  or (length(regexp_replace({t}, '[^A-Z]', '', 'g')) >= 1 and regexp_matches({t}, '[0-9]'))))"""
TOKEN_SQL = r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*"


def line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("query_id")


LINE_ID_SQL = "l_orderkey || '-' || l_linenumber || '-' || l_partkey"


def part_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a fault record: its brand is the manual, its number gives the code."""
    code = code_of(F.col("p_partkey"))
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("manual_id"), code.alias("code"), code_key(code).alias("code_key"),
        F.col("p_name").alias("name"), F.col("p_size").alias("page"), F.concat_ws(":f:", "p_brand", code).alias("chunk_id"),
    )


def line_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item as a question naming its part's code; repeated lines are found where their number sends them."""
    return table(spark, sf, "lineitem").select(
        line_id(), F.concat(F.lit("line shows "), code_of(F.col("l_partkey"))).alias("text")
    ).repartition("query_id").distinct()


def asked_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The part codes keyed for detection, without the columns that no question asks for."""
    return search.code_index(part_codes(spark, sf).drop("name", "page"))


def code_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Code-shaped tokens of whole documents and pages."""
    texts = spread(table(spark, sf, "documents")).select(F.lit("doc").alias("src"), "text").unionByName(
        table(spark, sf, "pages").select(F.lit("page").alias("src"), F.col("html").alias("text"))
    )
    found = texts.select("src", F.explode(code_like_tokens(F.col("text"))).alias("token"))
    return found.groupBy("src", "token").agg(F.count("*").alias("n"))


CODE_TOKENS_SQL = f"""with t as (
  select 'doc' as src, unnest(regexp_extract_all(text, '{TOKEN_SQL}')) as token from documents
  union all select 'page' as src, unnest(regexp_extract_all(html, '{TOKEN_SQL}')) as token from pages)
select src, token, count(*) as n from t where {IS_CODE_SQL.format(t='token')} group by 1, 2"""


def lookalike_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Look-alike pairs over all part codes, across brands and within a brand."""
    codes = part_codes(spark, sf)
    everywhere = audit.lookalike_pairs(codes.withColumn("scope", F.lit("all")), ["scope"])
    inside = audit.lookalike_pairs(codes.withColumnRenamed("manual_id", "scope"), ["scope"])
    return everywhere.unionByName(inside)


PARTS_CTE = f"c as (select p_brand as manual, p_partkey, p_name, p_size, code, translate(code, '015', 'OIS') as fold from (select *, {CODE_SQL.format(k='p_partkey')} as code from part))"
PAIRS_SQL = f"""with {PARTS_CTE}
select 'all' as scope, a.code || '~' || b.code as pair from c a join c b using (fold) where a.code < b.code
union all
select a.manual as scope, a.code || '~' || b.code as pair from c a join c b using (fold, manual) where a.code < b.code"""


def lexicon_first(spark: SparkSession, sf: str) -> DataFrame:
    """First occurrence of every identifier per source; German text plays the code font, parts give the faults."""
    docs = spread(table(spark, sf, "documents"))
    font = F.when(F.col("lang") == "de", F.lit("CourierNewPS-BoldMT")).otherwise(F.lit("ArialMT"))
    lines = docs.select(
        F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), F.col("doc_id").alias("pos"), "text",
        F.array(F.struct(F.col("text").alias("text"), font.alias("font"), F.lit(10.0).alias("size"))).alias("spans"),
    )
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("src"), F.col("p_size")).alias("manual_id"), code_of(F.col("p_partkey")).alias("code"),
        code_of(F.col("p_partkey")).alias("code_key"), F.col("p_name").alias("name"), F.col("p_size").alias("page"),
        F.col("p_partkey").alias("ord"),
    )
    return lexicon.build_lexicon(lines, parts)


LEXICON_SQL = f"""with toks as (
  select source as manual_id, lang, doc_id, unnest(regexp_extract_all(text, '{TOKEN_SQL}')) as code,
    generate_subscripts(regexp_extract_all(text, '{TOKEN_SQL}'), 1) as i from documents),
labs as (select source as manual_id, doc_id, unnest(regexp_extract_all(text, '\\[([^\\[\\]\\n]{{2,60}})\\]', 1)) as code,
    generate_subscripts(regexp_extract_all(text, '\\[([^\\[\\]\\n]{{2,60}})\\]', 1), 1) as i from documents),
e as (
  select manual_id, 'token' as kind, upper(code) as code_key, code, null as label, doc_id as page, 1 as o1, doc_id as o2, i from toks
    where {IS_CODE_SQL.format(t='code')}
  union all select manual_id, 'hmi', upper(code), code, null, doc_id, 1, doc_id, i from toks where lang = 'de'
  union all select manual_id, 'label', lower(trim(regexp_replace(code, '\\s+', ' ', 'g'))), trim(code), null, doc_id, 1, doc_id, i from labs
  union all select 'src' || p_size, 'fault', {CODE_SQL.format(k='p_partkey')}, {CODE_SQL.format(k='p_partkey')}, p_name, p_size, 0, p_partkey, 0 from part
  union all select 'src' || p_size, 'label', lower(p_name), p_name, null, p_size, 0, p_partkey, 0 from part)
select manual_id, kind, code_key, code, label, page::int as first_page from e
qualify row_number() over (partition by manual_id, kind, code_key order by o1, o2, i) = 1"""


def missing_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Per brand: codes expected (all parts) but not extracted; extracted are parts whose lines ask for more than 25 pieces on average."""
    expected = part_codes(spark, sf).withColumnRenamed("manual_id", "doc_id")
    asked = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity") - 25).alias("over"))
    asked = asked.where("over > 0").select(code_of(F.col("l_partkey")).alias("code_key"))
    extracted = expected.join(asked, "code_key", "left_semi").select("doc_id", "code_key", "code")
    lost = audit.missing_codes(expected, extracted)
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("id")).distinct()
    faults = extracted.withColumnRenamed("doc_id", "manual_id")
    chunks = faults.select("manual_id", F.lit("section").alias("kind"))
    report = audit.manual_reports(brands, faults, chunks, missing=lost)
    return report.select(
        F.col("doc_id").alias("brand"), "fault_records", "missing", F.array_join("problems", "; ").alias("problems")
    )


MISSING_SQL = f"""with {PARTS_CTE},
seen as (select {CODE_SQL.format(k='l_partkey')} as code from lineitem group by l_partkey having sum(l_quantity - 25) > 0),
r as (select manual, count(*) filter (where code in (select code from seen)) as got,
  count(*) filter (where code not in (select code from seen)) as missing from c group by manual)
select manual as brand, got as fault_records, missing,
  case when missing > 0 then missing || ' codes expected but not extracted; ' else '' end || 'no safety chunk on the configured safety pages' as problems
from r"""


def detect_codes(spark: SparkSession, sf: str) -> DataFrame:
    found = search.detect_codes(line_questions(spark, sf), asked_codes(spark, sf))
    return found.select("query_id", "ord", "token", "fuzzy", "manual_id", "code", "chunk_id")


DETECT_CTES = f"""{PARTS_CTE},
q as (select distinct {LINE_ID_SQL} as query_id, l_partkey, {CODE_SQL.format(k='l_partkey')} as token,
    translate({CODE_SQL.format(k='l_partkey')}, '015', 'OIS') as fold from lineitem),
h as (select query_id, token, token <> c.code as fuzzy, manual, c.code from q join c using (fold) where length(token) between 3 and 6
  and (token = c.code or regexp_matches(token, '[0-9]') or not regexp_matches(token, '[a-z]'))),
k as (select *, bool_or(not fuzzy) over (partition by query_id, manual) as exact_here from h),
m as (select * from k where not fuzzy or not exact_here)"""
DETECT_SQL = f"""with {DETECT_CTES}
select query_id, row_number() over (partition by query_id order by fuzzy, case when fuzzy then code end, manual, code) as ord,
  token, fuzzy, manual as manual_id, code, manual || ':f:' || code as chunk_id from m"""


def code_match(spark: SparkSession, sf: str) -> DataFrame:
    """Each line question expects its part's code; customers' last lines expect the next part's code as well."""
    asked = line_questions(spark, sf)
    flags = table(spark, sf, "lineitem").select(
        line_id(), "l_partkey", "l_returnflag"
    )
    own = flags.where("l_returnflag <> 'N'").select("query_id", code_of(F.col("l_partkey")).alias("code"))
    following = flags.where("l_returnflag = 'A'").select("query_id", code_of(F.col("l_partkey") + 1).alias("code"))
    # Which codes were detected does not depend on their order.
    detected = search.code_hits(asked, asked_codes(spark, sf)).select("query_id", "code")
    return evaluate.code_match(own.unionByName(following), detected, asked)


CODE_MATCH_SQL = f"""with {DETECT_CTES},
w as (select {LINE_ID_SQL} as query_id, l_returnflag as f, unnest([l_partkey, l_partkey + 1]) as k, unnest([0, 1]) as nxt from lineitem),
e as (select query_id, translate({CODE_SQL.format(k='k')}, '015', 'OIS') as fold from w where (nxt = 0 and f <> 'N') or f = 'A'),
d as (select distinct query_id, translate(code, '015', 'OIS') as fold from m),
v as (select e.query_id, bool_and(d.fold is not null) as matched from e left join d using (query_id, fold) group by 1)
select q.query_id, v.matched from q left join v using (query_id)"""


def order_answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as answers naming the codes of their lines and of the parts after them; scopes are the lines' brands."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    named = F.concat_ws(" ", code_of(F.col("l_partkey")), code_of(F.col("l_partkey") + 1))
    texts = lines.withColumn("t", named).groupBy(F.col("l_orderkey").alias("query_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))), lambda x: x["t"]), " ").alias("text")
    )
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("manual_id"))
    scopes = lines.join(brands, "l_partkey").select(F.col("l_orderkey").alias("query_id"), "manual_id").distinct()
    return texts, scopes


def audit_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    texts, scopes = order_answers(spark, sf)
    entries = part_codes(spark, sf).select("manual_id", F.lit("fault").alias("kind"), "code_key")
    known = lexicon.known_identifiers(entries)
    found = triage.unknown_identifiers(texts, scopes, known, ["query_id"])
    return found.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "identifier"))), lambda x: x["identifier"]), " ").alias("unknown")
    )


AUDIT_SQL = f"""with {PARTS_CTE},
t as (select l_orderkey as query_id, row_number() over (partition by l_orderkey order by l_linenumber, {CODE_SQL.format(k='l_partkey')}, nxt) as place,
    {CODE_SQL.format(k='k')} as tok, translate({CODE_SQL.format(k='k')}, '015', 'OIS') as fold
  from (select l_orderkey, l_linenumber, l_partkey, unnest([l_partkey, l_partkey + 1]) as k, unnest([0, 1]) as nxt from lineitem)),
s as (select distinct l_orderkey as query_id, p_brand as manual from lineitem join part on p_partkey = l_partkey),
known as (select distinct s.query_id, c.fold from s join c using (manual)),
u as (select t.* from t left join known using (query_id, fold) where known.fold is null and length(tok) >= 2
  and tok not in ('AC', 'DC', 'PE', 'OK', 'ID')),
f as (select query_id, tok, min(place) as place from u group by 1, 2)
select query_id, string_agg(tok, ' ' order by place) as unknown from f group by 1"""


def scope_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders name the brands of their lines; brands whose parts are larger than 25 on average have a manual."""
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").join(
        part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"
    )
    words = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_brand"))), lambda x: x["p_brand"])
    named = lines.groupBy("l_orderkey").agg(F.array_join(words, " and ").alias("brands"))
    orders = table(spark, sf, "orders").join(named, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    asked = orders.select(
        F.col("o_orderkey").alias("query_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("drive trips")).otherwise(F.concat_ws(" ", F.lit("trips on"), "brands")).alias("text"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("C"), F.col("o_custkey"))).alias("machine_id"), "o_totalprice",
    )
    machines = table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey")).alias("id"), F.col("c_mktsegment").alias("manual")
    )
    manuals = part.groupBy(F.col("p_brand").alias("id")).agg(F.sum(F.col("p_size") - 25).alias("over")).where("over > 0").select(
        "id", F.array("id").alias("models")
    )
    models = lexicon.named_models(asked, [(r"(Brand)(#[0-9]+)", None)])
    scoped, uncovered, _ = triage.resolve_scope(asked, machines, models, lexicon.model_manuals(manuals))
    gated = triage.evidence_gate(
        scoped.withColumns({"has_code": F.col("text").contains("Brand#2"), "top_score": F.col("o_totalprice") / 500000}), 0.3
    )
    shape = lambda df, reason: df.select(
        "query_id", F.array_join("scope", "|").alias("scope"), F.array_join("models", "|").alias("models"), reason.alias("reason")
    )
    return shape(gated, F.col("gate_reason")).unionByName(shape(uncovered, F.lit("uncovered")))


SCOPE_SQL = """with f as (select l_orderkey, string_agg(p_brand, ' and ' order by l_linenumber, p_brand) as brands,
    list(p_brand order by l_linenumber, p_brand) as bs from lineitem join part on p_partkey = l_partkey group by 1),
q as (select o_orderkey as query_id, o_orderstatus as st, o_custkey, o_totalprice / 500000 as top,
    case when o_orderstatus = 'F' or bs is null then [] else bs end as bs from orders left join f on l_orderkey = o_orderkey),
m as (select upper(p_brand) as model, p_brand as manual from part group by p_brand having sum(p_size - 25) > 0),
n as (select query_id, list(b order by i) as models from (
    select query_id, upper(b) as b, min(i) as i from (select query_id, unnest(bs) as b, generate_subscripts(bs, 1) as i from q) group by 1, 2) group by 1),
c as (select query_id, list(manual order by manual) as covered from (select distinct query_id, manual from
    (select query_id, upper(unnest(bs)) as model from q) join m using (model)) group by 1)
select q.query_id,
  case when n.models is not null and c.covered is null then case when st <> 'P' then c_mktsegment end
    else coalesce(array_to_string(c.covered, '|'), case when st <> 'P' then c_mktsegment end) end as scope,
  array_to_string(n.models, '|') as models,
  case when n.models is not null and c.covered is null then 'uncovered'
    when not coalesce(list_contains(list_transform(n.models, lambda x: starts_with(x, 'BRAND#2')), true), false) and top < 0.3 then
      printf('No fault code was recognised and the closest manual passage scored %.2f, below the evidence threshold of 0.30.', top) end as reason
from q left join n using (query_id) left join c using (query_id) left join customer on c_custkey = o_custkey"""


def repeated_causes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as causes, a source's documents as one answer."""
    docs = table(spark, sf, "documents").select("source", F.col("doc_id").alias("n"), "text")
    return triage.repeated_causes(docs, ["source"])


REPEATS_SQL = """with d as (select source, doc_id as n, lower(trim(regexp_replace(text, '[\\s\\v\\p{Z}\\x{85}\\x1c-\\x1f]+', ' ', 'g'), ' .;:!')) as k from documents),
f as (select *, min(n) over (partition by source, k) as first from d)
select source, n, first from f where n <> first"""


def draft_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a seed: small ones name their brand and a look-alike spelling, the others ask all brands."""
    faults = part_codes(spark, sf).select(
        "manual_id", "code", "code_key", "page", (F.col("page") + 1).alias("page_end"), F.array("name", "code").alias("causes")
    )
    # One record per brand and key, as extraction leaves it.
    spelled = F.translate(code_of(F.col("p_partkey")), "OIS", "015")
    seeds = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.array(F.struct(F.when(F.col("p_size") <= 25, F.col("p_brand")).alias("manual"), spelled.alias("code"))).alias("targets"),
    )
    found, _ = evaluate.draft_targets(seeds, faults)
    return found.select("id", "manual_id", "code", "page", F.array_join("causes", "|").alias("causes"))


DRAFT_SQL = f"""with {PARTS_CTE},
s as (select p_partkey as id, case when p_size <= 25 then p_brand end as wanted, translate({CODE_SQL.format(k='p_partkey')}, 'OIS', '015') as key,
    translate({CODE_SQL.format(k='p_partkey')}, '015', 'OIS') as fold from part)
select id, manual as manual_id, code, p_size as page, p_name || '|' || code as causes from s join c using (fold)
where wanted is null or wanted = manual
qualify row_number() over (partition by id, manual order by code <> key, code) = 1"""


QUERIES = {
    "code_tokens": (code_tokens, CODE_TOKENS_SQL),
    "lookalike_pairs": (lookalike_pairs, PAIRS_SQL),
    "lexicon_first": (lexicon_first, LEXICON_SQL),
    "missing_codes": (missing_codes, MISSING_SQL),
    "detect_codes": (detect_codes, DETECT_SQL),
    "code_match": (code_match, CODE_MATCH_SQL),
    "audit_identifiers": (audit_identifiers, AUDIT_SQL),
    "scope_gate": (scope_gate, SCOPE_SQL),
    "repeated_causes": (repeated_causes, REPEATS_SQL),
    "draft_targets": (draft_targets, DRAFT_SQL),
}
