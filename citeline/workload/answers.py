"""Registered queries: contexts, answer audits, masking, translation and evaluation."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.functions.text import detect_script
from citeline.operators import evaluate, lexicon, search, translate, triage
from citeline.operators.vectors import Lane, vector_topk
from citeline.session import settle, spread
from citeline.workload.codes import PARTS_CTE, part_codes
from citeline.workload.common import CODE_SQL, SPACE_SQL, code_of, table
from citeline.workload.retrieval import KEYWORD_CTES, questions

SCRIPT_BLOCKS = (("fr", "[éèêçàùâîôû]"), ("de", "[äöüß]"), ("es", "[ñáíóú¿¡]"))


def context_text(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt texts over the best keyword passages; toxic documents are the safety passages of their source."""
    docs = table(spark, sf, "documents")
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("safety").alias("kind"))
    passages = docs.join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("passage_id"), F.col("source").alias("manual_id"), F.coalesce("kind", F.lit("section")).alias("kind"),
        F.col("lang").alias("heading"), "text", F.col("doc_id").alias("page_start"),
        F.when(F.col("lang") == "en", F.col("doc_id")).otherwise(F.col("doc_id") + 1).alias("page_end"),
    )
    asked = questions(spark, sf)
    terms = search.query_terms(asked)
    found = search.keyword_topk(terms, search.postings(passages, only=terms), search.TOP_K)
    ranked = settle(found.select("query_id", F.col("rank").alias("pos"), "passage_id", "score"), "ranked")
    manuals = docs.select(F.col("source").alias("id")).distinct().select(
        "id", F.upper("id").alias("family"), F.concat(F.lit('Handbook "'), "id", F.lit('"')).alias("title"),
        F.when(F.length("id") == 4, F.array("id", F.concat("id", F.lit("x")))).alias("models"),
    )
    sources = triage.number_sources(ranked, passages, manuals)
    contexts = triage.build_contexts(asked, sources)
    return contexts.select("query_id", F.length("context").alias("chars"), F.md5("context").alias("digest"))


CONTEXT_SQL = f"""with {KEYWORD_CTES},
ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as pos from kw qualify pos <= {search.TOP_K}),
d as (select documents.*, case when toxic = 1 then 'safety' else 'section' end as kind from documents left join labels using (doc_id)),
hits as (select query_id, pos, d.* from ranked join d using (doc_id)),
safe as (select distinct h.query_id, null::bigint as pos, d.* from (select distinct query_id, source from hits) h join d on d.source = h.source
  where d.kind = 'safety' and not exists (select 1 from ranked r where r.query_id = h.query_id and r.doc_id = d.doc_id)),
n as (select *, row_number() over (partition by query_id order by pos nulls last, source, doc_id) as n from
  (select * from hits union all by name select * from safe)),
b as (select query_id, string_agg('<source id="S' || n || '" ' ||
  case when length(source) = 4 then 'models="' || source || ', ' || source || 'x"' else 'model="' || upper(source) || '"' end ||
  ' manual="Handbook ''' || source || '''" pages="' || case when lang = 'en' then 'p.' || doc_id else 'pp.' || doc_id || '-' || (doc_id + 1) end ||
  '" kind="' || kind || '" section="' || lang || '">' || chr(10) || text || chr(10) || '</source>', chr(10) || chr(10) order by n) as blocks from n group by 1),
c as (select item_id as query_id, 'MACHINE: not specified' || chr(10) || chr(10) || 'SOURCES:' || chr(10) || chr(10) || coalesce(blocks || chr(10) || chr(10), '')
  || 'OPERATOR QUERY:' || chr(10) || text as context from benchmark left join b on b.query_id = item_id)
select query_id, length(context) as chars, md5(context) as digest from c"""


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, lines): every order with all its lines in order, as line numbers repeat; an answer is one cell."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    line = F.struct("l_linenumber", "l_partkey", "l_returnflag", "p_name", "p_brand")
    return table(spark, sf, "lineitem").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(line)), lambda x, i: F.struct(
            (i + 1).alias("line"), x["l_partkey"].alias("part"), x["p_name"].alias("p_name"), x["p_brand"].alias("p_brand"),
            x["l_returnflag"].alias("flag"),
        )).alias("lines")
    )


def judge_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Two drafted answers per order, as JSON: parsed, audited, decided.

    The first lists every line as a cause, the second only lines without flag A. Sources are the lines without flag
    A; a cause cites its line and names its part's code.
    """
    orders = settle(_order_lines(spark, sf), "lines")
    clear = F.filter("lines", lambda x: x["flag"] != "A")
    drafts = orders.select("query_id", F.posexplode(F.array("lines", clear)).alias("attempt", "lines"))
    causes = F.transform("lines", lambda x: F.struct(
        x["p_name"].alias("cause"), F.lit(0.5).alias("confidence"), code_of(x["part"]).alias("fault_code"),
        F.array(F.concat(F.lit("S"), x["line"].cast("string"))).alias("source_ids"),
    ))
    body = F.struct(
        F.lit("diagnosis").alias("status"), F.lit("").alias("insufficient_reason"), causes.alias("probable_causes"),
        F.array().cast("array<struct<action:string,requires_isolation:boolean,source_ids:array<string>>>").alias("corrective_actions"),
        F.array().cast("array<struct<text:string,source_ids:array<string>>>").alias("safety_warnings"),
    )
    raw = drafts.select("query_id", (F.col("attempt") + 1).alias("attempt"), F.to_json(body).alias("answer_json"))
    answers = settle(triage.parse_answers(raw).drop("answer_json"), "answers")
    sources = orders.select("query_id", F.explode(clear).alias("x")).select(
        "query_id", F.concat(F.lit("S"), F.col("x.line").cast("string")).alias("source_id"), F.col("x.p_brand").alias("manual_id"),
        F.lit("section").alias("kind"),
    )
    entries = part_codes(spark, sf).select("manual_id", F.lit("fault").alias("kind"), "code_key")
    known = lexicon.known_identifiers(entries)
    decided = triage.decide(triage.audit_answers(answers, sources, known, carry=("answer",)))
    return decided.select(
        "query_id", "attempt", "reason", F.array_join("first_pass_violations", " | ").alias("first_pass"),
        F.size("answer.probable_causes").alias("causes"),
    )


JUDGE_SQL = f"""with {PARTS_CTE},
l as (select l_orderkey as query_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) as line,
    l_partkey as part, l_returnflag as flag from lineitem join part on p_partkey = l_partkey),
x as (select l.*, c.p_name as name, c.manual as brand, c.code, c.fold from l join c on c.p_partkey = l.part),
q as (select distinct query_id from x),
s as (select distinct x.query_id, c.fold from x join c on c.manual = x.brand where x.flag <> 'A'),
d as (select query_id, attempt, flag, code, fold, lower(name) as k, line,
    row_number() over (partition by query_id, attempt order by line) as n
  from x cross join (select unnest([1, 2]) as attempt) where attempt = 1 or flag <> 'A'),
v as (
  select query_id, attempt, n, 1 as step, 'cause ' || n || ': unknown source id S' || line as note from d where flag = 'A'
  union all
  select d.query_id, attempt, n, 3, 'cause ' || n || ': unknown identifier ' || code from d left join s using (query_id, fold) where s.fold is null
  union all
  select query_id, attempt, n, 4, 'cause ' || n || ' repeats cause ' || f || ': list each cause once' from
    (select *, min(n) over (partition by query_id, attempt, k) as f from d) where f <> n
  union all
  select q.query_id, a.attempt, 0, 0, 'no probable causes returned' from q cross join (select unnest([1, 2]) as attempt) a
    where not exists (select 1 from d where d.query_id = q.query_id and d.attempt = a.attempt)),
g as (select q.query_id, a.attempt, list(note order by n, step, note) filter (note is not null) as notes
  from q cross join (select unnest([1, 2]) as attempt) a left join v on v.query_id = q.query_id and v.attempt = a.attempt group by 1, 2),
o as (select a.query_id, a.notes as n1, b.notes as n2 from g a join g b on a.query_id = b.query_id and a.attempt = 1 and b.attempt = 2)
select o.query_id, case when n1 is null then 1 else 2 end as attempt,
  case when n1 is not null and n2 is not null then 'The drafted answer failed the grounding checks twice: ' || array_to_string(n2[1:3], '; ') || '.' end as reason,
  coalesce(array_to_string(n1, ' | '), '') as first_pass,
  case when n1 is null then (select count(*) from d where d.query_id = o.query_id and attempt = 1)
       when n2 is null then (select count(*) from d where d.query_id = o.query_id and attempt = 2) end as causes
from o"""


def confidence_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Every document; one without labels counts as unrecognised with no retrieval strength."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").fillna(0, ["toxic", "quality"])
    conf = F.sqrt(F.col("n_chars").cast("double")) / 100 - 0.1
    capped = triage.capped_confidence(conf, F.col("toxic") == 1, F.col("quality") * 0.437)
    return rows.select("doc_id", capped.alias("confidence"))


CONFIDENCE_SQL = """select doc_id, round_even(least(greatest(sqrt(n_chars) / 100 - 0.1, 0), 1, case when toxic = 1 then 1.0::double
  else coalesce(quality, 0) * 0.437::double end), 2) as confidence from documents left join labels using (doc_id)"""


def validate_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as reports: accepted ones with their stripped text, rejected ones with the reason."""
    accepted, rejected = triage.validate_reports(table(spark, sf, "documents").select("doc_id", "text"))
    return accepted.select("doc_id", F.md5("text").alias("outcome")).unionByName(rejected.select("doc_id", F.col("reason").alias("outcome")))


VALIDATE_SQL = f"""with b as (select doc_id, text, regexp_replace(text, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') as bare from documents)
select doc_id, case when length(text) > 2000 then 'query is too long' when bare = '' then 'query must not be empty'
  when regexp_matches(bare, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') then 'query must not contain control characters' else md5(bare) end as outcome from b"""


def script_detect(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents")).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return docs.unionByName(turns).select("id", detect_script(F.col("text"), SCRIPT_BLOCKS).alias("script"))


SCRIPT_SQL = """with t as (select 'd' || doc_id as id, text from documents union all select 'c' || conv_id || '-' || turn as id, text from conversations),
n as (select id, length(regexp_replace(text, '[^éèêçàùâîôû]', '', 'g')) as fr, length(regexp_replace(text, '[^äöüß]', '', 'g')) as de,
  length(regexp_replace(text, '[^ñáíóú¿¡]', '', 'g')) as es from t)
select id, case when greatest(fr, de, es) = 0 then 'en' when fr = greatest(fr, de, es) then 'fr' when de = greatest(fr, de, es) then 'de' else 'es' end as script from n"""


def _coded_documents(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.concat(F.lit(" [Brake release] "), code_of(F.col("doc_id") + 256), F.lit(" after 15 minutes, see pp. 12-13."))
    return spread(table(spark, sf, "documents")).select("doc_id", "lang", F.concat("text", tail).alias("text"))


CODED_SQL = f"(select doc_id, lang, text || ' [Brake release] ' || {CODE_SQL.format(k='(doc_id + 256)')} || ' after 15 minutes, see pp. 12-13.' as text from documents)"


def mask_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Masked and restored whole documents; French ones lose a marker on the way, so they restore to NULL."""
    from citeline.functions.text import restore_spans

    masked = translate.mask_corpus(_coded_documents(spark, sf))
    sent = F.when(F.col("lang") == "fr", F.regexp_replace("masked", "(?s)^(.*?)ZQA(?![A-P])", "$1")).otherwise(F.col("masked"))
    back = restore_spans(sent, F.col("kept"))
    return masked.select("doc_id", F.md5(back).alias("digest"), F.array_contains("kept", "15 minutes").alias("quantity"))


MASK_SQL = f"select doc_id, case when lang <> 'fr' then md5(text) end as digest, true as quantity from {CODED_SQL}"


def sentence_join(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence tables sent out and joined back; the first sentence of German documents comes back blank."""
    docs = _coded_documents(spark, sf)
    masked = translate.mask_corpus(docs)
    asked = translate.segments(masked, ["doc_id"])
    out = F.when((F.col("lang") == "de") & (F.col("seg") == 0), F.lit(" ")).otherwise(F.col("segment"))
    translated = asked.join(docs.select("doc_id", "lang"), "doc_id").withColumn("output", out)
    restored = translate.restore_corpus(masked, asked, translated, ["doc_id"])
    shown = translate.with_fallback(docs, restored, ["doc_id"])
    return shown.select("doc_id", F.md5("shown").alias("digest"), "fallback")


SENTENCE_SQL = f"""with s as (select doc_id, lang, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text,
    '([.!?।]){SPACE_SQL}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)),
    lambda p: regexp_replace(p, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')), lambda p: p <> '') as parts from {CODED_SQL})
select doc_id, md5(case when lang = 'de' then text else array_to_string(parts, ' ') end) as digest, lang = 'de' as fallback from s"""


def hit_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as questions that expect the next vector's page under their own label; label 0 expects nothing."""
    vecs = table(spark, sf, "embeddings")
    asked = vecs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    known = vecs.select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vector"))
    found = vector_topk(asked.drop("label"), known, [Lane("vector", 5)])
    retrieved = found.join(vecs.select(F.col("vec_id").alias("passage_id"), F.col("label").cast("string").alias("manual")), "passage_id").select(
        "query_id", F.col("rank").alias("pos"), "manual", (F.col("passage_id") - 10).alias("page_start"), (F.col("passage_id") + 10).alias("page_end")
    )
    expected = asked.where("label <> 0").select(
        "query_id", F.col("label").cast("string").alias("manual"), (F.col("query_id") + 11).alias("page")
    )
    return evaluate.hit_at_k(expected, retrieved, asked)


HIT_SQL = """with pairs as (
  select a.vec_id as query_id, a.label as want, b.vec_id as vec_id, b.label as got,
         round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as s
  from embeddings a cross join embeddings b),
r as (select *, row_number() over (partition by query_id order by s desc, vec_id) as rank from pairs qualify rank <= 5)
select query_id, case when want <> 0 then bool_or(got = want and query_id + 11 between vec_id - 10 and vec_id + 10) end as hit
from r group by query_id, want"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """One result row per document; unlabelled documents are not applicable."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    return rows.select(
        F.col("doc_id").alias("id"), good.alias("hit_at_5"), bad.alias("code_match"),
        F.when(F.col("lang") == "en", good).alias("cause_at_3"), F.when(bad, good).alias("raw_hallucination"),
        (good & bad).alias("final_hallucination"), F.when(good, bad).alias("refusal_correct"),
        F.when(F.col("lang") == "xx", good).alias("false_escalation"), F.lit("x").alias("status"),
        F.col("quality").alias("citations_correct"), F.when(F.col("quality").isNotNull(), F.length("lang")).alias("citations_total"),
        F.coalesce("toxic", F.lit(0)).alias("translation_fallbacks"), F.when(F.col("lang") == "xx", 1).otherwise(0).alias("translation_total"),
    )


def summary_rates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.summarize(_results(spark, sf)).select("metric", F.round("value", 9).alias("value"), "n")


SUMMARY_SQL = """with r as (select *, quality = 1 as g, toxic = 1 as b from documents left join labels using (doc_id)),
m as (
  select 'retrieval_hit_at_5' as metric, avg(g::int) as value, count(g) as n from r
  union all select 'fault_code_match', avg(b::int), count(b) from r
  union all select 'cause_in_top_3', avg(g::int) filter (lang = 'en'), count(g) filter (lang = 'en') from r
  union all select 'citation_accuracy', sum(quality) / sum(length(lang)) filter (quality is not null), coalesce(sum(length(lang)) filter (quality is not null), 0)::bigint from r
  union all select 'hallucination_raw', avg(g::int) filter (b), count(g) filter (b) from r
  union all select 'hallucination_final', avg((g and b)::int), count(g and b) from r
  union all select 'out_of_scope_refusal', avg(b::int) filter (g), count(b) filter (g) from r
  union all select 'false_escalation', null, 0
  union all select 'translation_fallback', null, 0)
select metric, round(value::double, 9) as value, n from m"""


def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.scorecard_rows(evaluate.summarize(_results(spark, sf))).select("label", "shown", "n")


SCORECARD_SQL = f"""with s as ({SUMMARY_SQL}), l as (select unnest({list(evaluate.METRICS)!r}) as metric, unnest([{', '.join("'" + v + "'" for v in evaluate.METRICS.values())}]) as label)
select label, coalesce(printf('%.1f%%', value * 100), 'n/a') as shown, n from l join s using (metric)"""


def nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", [50, 95])


RANK_SQL = """with s as (select event_type, list(value order by value) as vs from events group by 1),
p as (select *, unnest([50, 95]) as p from s)
select event_type, p, vs[round_even(p / 100 * (len(vs) - 1), 0)::int + 1] as value from p"""


def run_flips(spark: SparkSession, sf: str) -> DataFrame:
    """The labels of a document as two runs: quality before, toxicity after."""
    labels = table(spark, sf, "labels")
    run = lambda c: labels.select(
        F.col("doc_id").cast("string").alias("id"), (F.col(c) == 1).alias("hit_at_5"), F.when(F.col(c) == 1, "diagnosis").alias("status")
    )
    flips = evaluate.run_flips(run("quality"), run("toxic"), ("hit_at_5", "status"))
    return flips.select(evaluate.flip_text(F.col("id"), F.col("field"), F.col("before"), F.col("after")).alias("flip"))


FLIPS_SQL = """with f as (select doc_id, quality = 1 as a, toxic = 1 as b from labels where quality <> toxic)
select doc_id || ': hit_at_5 ' || case when a then 'True' else 'False' end || ' -> ' || case when b then 'True' else 'False' end as flip from f
union all
select doc_id || ': status ' || case when a then 'diagnosis' else 'None' end || ' -> ' || case when b then 'diagnosis' else 'None' end from f"""


def compare_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """English results against all results, metric by metric."""
    results = _results(spark, sf)
    english = results.join(table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return evaluate.compare_metrics(evaluate.summarize(english), evaluate.summarize(results)).drop("ord")


COMPARE_SQL = f"""with a as ({SUMMARY_SQL.replace('from documents left join', "from (from documents where lang = 'en') left join")}),
b as ({SUMMARY_SQL}), l as (select unnest({list(evaluate.METRICS)!r}) as metric, unnest([{', '.join("'" + v + "'" for v in evaluate.METRICS.values())}]) as label)
select label, coalesce(printf('%.1f%%', a.value * 100), 'n/a') as a, coalesce(printf('%.1f%%', b.value * 100), 'n/a') as b,
  coalesce(case when (b.value - a.value) * 100 >= 0 then '+' else '' end || printf('%.1f pts', (b.value - a.value) * 100), 'n/a') as delta
from l join a using (metric) join b using (metric)"""


def cause_top3(spark: SparkSession, sf: str) -> DataFrame:
    """Per label: each vector is an expected cause, the label's first three vectors are the answers."""
    vecs = table(spark, sf, "embeddings").select(
        F.col("label").alias("query_id"), F.col("vec_id").alias("n"), F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("vector")
    )
    from citeline.operators.scans import top_per_group

    answers = top_per_group(vecs, ["query_id"], [F.col("n")], 3).drop("n")
    asked = vecs.select("query_id").distinct()
    verdicts, pairs = evaluate.cause_at_3(vecs, answers, asked)
    return pairs.join(verdicts, "query_id").select("query_id", "n", "answer", "score", "cause_at_3")


CAUSE_SQL = """with a as (select *, row_number() over (partition by label order by vec_id) as rank from embeddings qualify rank <= 3),
p as (select e.label as query_id, e.vec_id as n, a.vec_id::varchar as answer, rank,
    list_cosine_similarity(e.embedding::double[], a.embedding::double[]) as sim from embeddings e join a using (label)),
b as (select *, round_even(sim, 3) + 0.0::double as score from p qualify row_number() over (partition by n order by round(sim, 9) desc, rank) = 1)
select query_id, n, answer, score, bool_or(score >= 0.65) over (partition by query_id) as cause_at_3 from b"""


def citation_rate(spark: SparkSession, sf: str) -> DataFrame:
    """A source cites all its documents; labelled ones are its sources, toxic ones of them safety passages."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("source_id"), "lang")
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "source_id")
    sources = docs.join(labels, "source_id").select(
        "query_id", "source_id", F.col("lang").alias("manual"), F.col("quality").alias("page_start"), F.lit(1).alias("page_end"),
        F.when(F.col("toxic") == 1, "safety").otherwise("section").alias("kind"),
    )
    expected = docs.select("query_id").distinct().select("query_id", F.lit("en").alias("manual"), F.lit(0).alias("page"))
    return evaluate.citation_accuracy(docs.drop("lang"), sources, expected)


CITATION_SQL = """select source as query_id, count(*) filter (toxic = 0 and lang = 'en' and quality = 0) as correct, count(*) as total
from documents left join labels using (doc_id) where toxic is null or toxic = 0 group by 1"""


QUERIES = {
    "context_text": (context_text, CONTEXT_SQL),
    "judge_answers": (judge_answers, JUDGE_SQL),
    "confidence_cap": (confidence_cap, CONFIDENCE_SQL),
    "validate_reports": (validate_reports, VALIDATE_SQL),
    "script_detect": (script_detect, SCRIPT_SQL),
    "mask_roundtrip": (mask_roundtrip, MASK_SQL),
    "sentence_join": (sentence_join, SENTENCE_SQL),
    "hit_at_k": (hit_at_k, HIT_SQL),
    "summary_rates": (summary_rates, SUMMARY_SQL),
    "scorecard": (scorecard, SCORECARD_SQL),
    "nearest_rank": (nearest_rank, RANK_SQL),
    "run_flips": (run_flips, FLIPS_SQL),
    "compare_metrics": (compare_metrics, COMPARE_SQL),
    "cause_top3": (cause_top3, CAUSE_SQL),
    "citation_rate": (citation_rate, CITATION_SQL),
}
