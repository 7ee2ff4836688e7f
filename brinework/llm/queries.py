"""The registered query of each operator, with its production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.llm.common import table


def op3_context_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.range_coder import coded_documents

    return coded_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.hamming_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op5_lattice_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.lattice import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.surrogates import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents"), key=SURROGATE_KEY)


def op7_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.fourier_quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.suffix_array import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


#: Production keeps its key elsewhere; with this one the queries' results can be compared.
SURROGATE_KEY = "brinework"


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.pitman_yor import document_scores

    return document_scores(table(spark, sf_dir, "documents"))


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.separator_scan import document_token_counts

    return document_token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.host_paths import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.piece_sampling import sampled_digest

    return sampled_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), least=10, inside=50, first=2000)


def op12_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.pivot_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brinework.llm.dual_tree import hard_negatives

    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", relabelled), F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_separator_scan": op2_separator_scan,
    "op3_context_mixing_coder": op3_context_mixing_coder,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_lattice_hashing": op5_lattice_hashing,
    "op6_surrogates": op6_surrogates,
    "op7_fourier_quality": op7_fourier_quality,
    "op8_suffix_array_decontamination": op8_suffix_array_decontamination,
    "op9_host_paths": op9_host_paths,
    "op10_piece_sampling": op10_piece_sampling,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_pivot_top_k": op12_pivot_top_k,
    "op13_dual_tree_negatives": op13_dual_tree_negatives,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: From links (u, v), both ways: reach (u, v) holds every document of each one's component.
_REACH = "reach as (select u, v from links union select r.u, l.v from reach r join links l on l.u = r.v)"

NEAR_DUPLICATES = f"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') w from documents),
g as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w),
n as (select doc_id, count(*) n from g group by doc_id),
met as (select a.doc_id u, b.doc_id v, count(*) c from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select u, v from met join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
{_REACH},
least as (select u, least(u, min(v)) m from reach group by u)
select d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(m, d.doc_id) component_id, d.doc_id = coalesce(m, d.doc_id) kept from documents d left join n using (doc_id) left join least on u = d.doc_id"""

EMBEDDING_LINKS = f"""with recursive e as (select vec_id, cast(embedding as double[]) x from embeddings),
ok as (select * from e where x is not null and len(x) > 0 and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and list_max(list_transform(x, lambda c: abs(c))) > 0),
links as (select a.vec_id u, b.vec_id v from ok a join ok b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.9),
n as (select u, count(*) n from links group by u), {_REACH},
least as (select u, least(u, min(v)) m from reach group by u)
select e.vec_id, coalesce(n.n, 0) n_links, coalesce(m, e.vec_id) component_id, e.vec_id = coalesce(m, e.vec_id) kept from e left join n on n.u = e.vec_id left join least l on l.u = e.vec_id"""

_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CONTAMINATION = f"""with d as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') w from documents), b as (select item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') w from benchmark),
grams as (select distinct item_id, least(10, len(w)) k, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) s from b where len(w) > 0),
sizes as (select distinct k from grams), starts as (select doc_id, k, w, unnest(range(1, len(w) - k + 2)) p from d cross join sizes where len(w) >= k),
found as (select t.doc_id, t.p, t.k, g.item_id from (select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') s from starts) t join grams g on g.k = t.k and g.s = t.s),
hit as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + k)) q from found) group by doc_id),
items as (select doc_id, count(*) n, string_agg(i, ',' order by i) names from (select distinct doc_id, cast(item_id as varchar) i from found) group by doc_id)
select d.doc_id, len(w) n_words, coalesce(hit.n, 0) n_hit, coalesce(items.n, 0) n_items, sha256(coalesce(names, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated from d left join hit using (doc_id) left join items using (doc_id)"""

_PIECES = f"regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')"
COLLOCATIONS = f"""with s as (select coalesce(lang, 'und') lang, unnest({_PIECES}) s from documents), w as (select lang, regexp_extract_all(s, '[^\\x20\\x09]+') w from s),
u as (select lang, unnest(w) x from w), f1 as (select lang, x, count(*) f from u group by all), t as (select lang, cast(sum(f) as bigint) n from f1 group by lang),
g as (select lang, unnest(list_transform(range(1, len(w)), lambda i: {{'p': w[i], 'q': w[i + 1]}})) g from w), f2 as (select lang, g.p p, g.q q, count(*) f from g group by all),
h as (select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'p': w[i], 'q': w[i + 1], 'r': w[i + 2]}})) g from w),
f3 as (select lang, g.p p, g.q q, g.r r, count(*) f from h group by all having count(*) >= 10),
c as (select f2.lang, f2.p || ' ' || f2.q phrase, f2.f a, 1 k, x.f l, y.f r from f2 join f1 x on x.lang = f2.lang and x.x = f2.p join f1 y on y.lang = f2.lang and y.x = f2.q
 where f2.f >= 10 and not exists (select 1 from f3 where f3.lang = f2.lang and (f3.p = f2.p and f3.q = f2.q or f3.q = f2.p and f3.r = f2.q) and 100 * f3.f >= 50 * f2.f)
 union all select f3.lang, f3.p || ' ' || f3.q || ' ' || f3.r, f3.f, 1, x.f, y.f from f3 join f1 x on x.lang = f3.lang and x.x = f3.p join f2 y on y.lang = f3.lang and y.p = f3.q and y.q = f3.r
 union all select f3.lang, f3.p || ' ' || f3.q || ' ' || f3.r, f3.f, 2, x.f, y.f from f3 join f2 x on x.lang = f3.lang and x.p = f3.p and x.q = f3.q join f1 y on y.lang = f3.lang and y.x = f3.r),
v as (select *, cast((cast(1000000 as hugeint) * a * a) // (cast(l as hugeint) * r) as bigint) score from c),
cut as (select *, row_number() over (partition by lang, phrase order by score, k) cut from v),
top as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from cut where cut = 1)
select lang, rank, phrase, a, l, r, n, score from top join t using (lang) where rank <= 2000"""

_INTEGERS = """e as (select vec_id, label, list_transform(cast(embedding as double[]), lambda x: cast(floor(256 * x) as bigint)) v from embeddings
 where embedding is not null and len(list_filter(cast(embedding as double[]), lambda c: c is null or not isfinite(c))) = 0)"""
_SCORE = "cast(list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])) as bigint)"

TOP_K = f"""with {_INTEGERS},
met as (select q.vec_id query_id, c.vec_id, {_SCORE.format(a="q.v", b="c.v")} score from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from met)
select query_id, cast(r as int) as rank, vec_id, score from ranked where r <= 5"""

HARD_NEGATIVES = f"""with {_INTEGERS}, l as (select vec_id, v, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label from e where label is not null),
met as (select q.vec_id anchor_id, c.vec_id, q.label = c.label same, {_SCORE.format(a="q.v", b="c.v")} score from l q join l c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
pos as (select anchor_id, vec_id positive_id, score positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) r from met where same),
neg as (select p.anchor_id, positive_id, positive_score, m.vec_id negative_id, m.score negative_score, row_number() over (partition by p.anchor_id, positive_id order by m.score desc, m.vec_id) r
 from pos p join met m on m.anchor_id = p.anchor_id and not m.same where p.r <= 5 and 30 * positive_score <= 100 * m.score and 100 * m.score <= 90 * positive_score)
select anchor_id, positive_id, cast(r as int) as rank, negative_id, positive_score, negative_score from neg where r <= 10"""

#: The others have no SQL form (sampling, learned models, coders, tokenizers); tests hold them against brute force, exact round trips or held-out rows.
ORACLE: dict[str, str] = {
    "op4_minhash_near_dedup": NEAR_DUPLICATES,
    "op5_lattice_hashing": EMBEDDING_LINKS,
    "op8_suffix_array_decontamination": CONTAMINATION,
    "op11_phrase_collocations": COLLOCATIONS,
    "op12_pivot_top_k": TOP_K,
    "op13_dual_tree_negatives": HARD_NEGATIVES,
}
