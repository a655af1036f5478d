"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgrid.llm import exact, forest, gam, mixing, packing, quality_rules, shallot, sharding, simhash, suffix, token_files, url_rules, whitening
from kelpgrid.llm.encoding import byte_bpe, word_bpe

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


OP1 = r"""
with d as (select *, coalesce(text, '') body from documents),
w as (select doc_id, lang, source, body, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
win as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') k from w, unnest(range(1, greatest(len(ws) - 3, 1))) t(i)),
twice as (select doc_id, k from win group by all having count(*) > 1),
pos as (select doc_id, i, lead(i) over (partition by doc_id order by i) nxt from win join twice using (doc_id, k)),
rep as (select doc_id, cast(sum(least(5, coalesce(nxt, i + 5) - i)) as bigint) n from pos group by doc_id),
m as (select w.doc_id, lang, source, len(ws) n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) word_chars,
             cast(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
             len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(n, 0) n_repeat_words, len(ls) n_lines
      from w left join rep using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
             case when n_words > 0 then 100 * word_chars // n_words else 0 end word_length, case when n_words > 0 then 1000 * n_symbols // n_words else 0 end symbols,
             case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end dup_lines, case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end repeats from m),
u as (unpivot (select lang, source, word_length, symbols, dup_lines, repeats from b where not base_failed) on word_length, symbols, dup_lines, repeats into name measure value v),
s as (select lang, source, measure, case when v < 64 then v else (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) end bucket, count(*) n from u group by all),
c as (select g, lang, source, measure, bucket, sum(n) over (partition by g, lang, source, measure) n, sum(n) over (partition by g, lang, source, measure order by bucket) cum
      from (select 0 g, lang, source, measure, bucket, sum(n) n from s group by all union all select 1, lang, null, measure, bucket, sum(n) from s group by all
            union all select 2, null, null, measure, bucket, sum(n) from s group by all)),
q as (select g, lang, source, measure, max(n) n, min(case when 4 * cum >= n then bucket end) b1, min(case when 4 * cum >= 3 * n then bucket end) b3 from c group by all),
t as (select g, lang, source, measure, n, case when b1 < 64 then b1 else ((b1 % 32 + 33) << (b1 // 32 - 1)) - 1 end q1, case when b3 < 64 then b3 else ((b3 % 32 + 33) << (b3 // 32 - 1)) - 1 end q3 from q),
f as (select o.lang, o.source, o.measure, case when o.n >= 200 then o.q1 when l.n >= 200 then l.q1 else a.q1 end q1, case when o.n >= 200 then o.q3 when l.n >= 200 then l.q3 else a.q3 end q3,
             case o.measure when 'word_length' then 50 when 'symbols' then 30 when 'dup_lines' then 60 else 40 end step
      from t o join t l on l.g = 1 and l.lang is not distinct from o.lang and l.measure = o.measure join t a on a.g = 2 and a.measure = o.measure where o.g = 0),
h as (select lang, source, max(case when measure = 'word_length' then q3 + 3 * greatest(q3 - q1, step) end) hi_w, max(case when measure = 'word_length' then q1 - 3 * greatest(q3 - q1, step) end) lo_w,
             max(case when measure = 'symbols' then q3 + 3 * greatest(q3 - q1, step) end) hi_s, max(case when measure = 'dup_lines' then q3 + 3 * greatest(q3 - q1, step) end) hi_d,
             max(case when measure = 'repeats' then q3 + 3 * greatest(q3 - q1, step) end) hi_r from f group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce(word_length >= lo_w and word_length <= hi_w and symbols <= hi_s and dup_lines <= hi_d and repeats <= hi_r, true) kept
from b left join h on h.lang is not distinct from b.lang and h.source is not distinct from b.source"""


@query("op1_quality_rules", OP1)
def op1_quality_rules(spark, sf_dir):
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.BASE_MEASURES, "base_failed", "kept")


@query("op2_token_files")
def op2_token_files(spark, sf_dir):
    folder = token_files.new_folder(spark)
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), byte_bpe(vocabulary_file("byte_bpe_50k.json")), folder)
    return token_files.read_token_files(manifest, folder)


OP3 = r"""
with p as (select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages),
u as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from p),
r(rule, host, path, verdict) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
d as (select distinct host, path from u),
fit as (select d.host, d.path, max({'n': length(rule), 'v': verdict, 'r': rule}) best from d join r
        on (d.host = r.host or suffix(d.host, '.' || r.host)) and prefix(d.path, r.path) group by all)
select page_id, u.host, u.path, best.r as rule,
       coalesce(best.v, case when regexp_matches(translate(u.path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/wp-login\.php|/cgi-bin/')
           or regexp_matches(u.host || ' ' || translate(u.path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^0-9a-z])(casino|porn|viagra)([^0-9a-z]|$)')
           then 'block' else 'allow' end) as verdict
from u left join fit on fit.host = u.host and fit.path = u.path"""


@query("op3_url_filters", OP3)
def op3_url_filters(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"))


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


# Production targets: three domains by the number of the source, English first within each.
DOMAINS = ("web", "reference", "books")
TARGETS = mixing.Targets(weights={("web",): 5.0, ("reference",): 3.0, ("books",): 2.0, **{(d, "en"): 6.0 for d in DOMAINS}}, ratio=1.0, max_epochs=2, seed=42)


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    return F.when(number < 10, "web").when(number < 15, "reference").otherwise("books")


@query("op5_mixing")
def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), TARGETS, domain_of(F.col("source")))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    out = suffix.repeated_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")


@query("op7_quality_classifier")
def op7_quality_classifier(spark, sf_dir):
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP8 = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
g as (select t, max(doc_id) keep_id, count(*) group_size from n group by t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(n.t) as text_sha256 from n join g on n.t = g.t"""


@query("op8_exact_dedup", OP8)
def op8_exact_dedup(spark, sf_dir):
    return exact.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op9_packing")
def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe(vocabulary_file("word_bpe_49k.json")))


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents")).drop("node")


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op12_clustering")
def op12_clustering(spark, sf_dir):
    return shallot.cluster(table(spark, sf_dir, "embeddings"))


@query("op13_neighbours")
def op13_neighbours(spark, sf_dir):
    return forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
