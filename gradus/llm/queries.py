"""Queries of the thirteen training-data operators over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import ann, byte_bpe, clusters, contamination, near_dedup, packing, phrases, pii, quality, repeats, token_count, toxicity, url_filter
from gradus.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path from u),
r(rhost, rpath, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (select page_id, max_by(rhost || rpath, length(rhost) + length(rpath)) as rule, max_by(verdict, length(rhost) + length(rpath)) as verdict
      from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select h.page_id, host, path, m.rule as rule, coalesce(m.verdict, 'allow') as verdict from h left join m using (page_id)
"""


def _repeated(n: int) -> str:
    """Columns of SQL: whether a word lies in an n-gram that its document holds twice."""
    return f"""g{n} as (select *, case when count(*) over span = {n} then string_agg(word, ' ') over span end as gram from words window span as (partition by doc_id order by i rows between current row and {n - 1} following)),
d{n} as (select *, gram is not null and count(*) over (partition by doc_id, gram) > 1 as twice from g{n}),
c{n} as (select doc_id, i, length(word) as chars, bool_or(twice) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as inside from d{n}),
s{n} as (select doc_id, count(*) filter (inside) as n_words, coalesce(sum(chars) filter (inside), 0)::bigint as chars from c{n} group by doc_id)"""


_SHARES = " and ".join([f"dup_line_chars <= {quality.LINE_SHARE}::double * word_chars", *(f"dup_chars_{n} <= {share}::double * word_chars" for n, share in quality.NGRAM_SHARE.items())])
OP5_SQL = rf"""
with words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)),
{", ".join(_repeated(n) for n in quality.NGRAM_SHARE)},
lines as (select doc_id, line, row_number() over (partition by doc_id, line order by k) as nth from (select doc_id, unnest(l) as line, unnest(range(len(l))) as k from (select doc_id, string_split(text, chr(10)) as l from documents)) where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) as n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::bigint as chars from lines where nth > 1 group by doc_id),
tot as (select doc_id, count(*) as n_words, sum(length(word))::bigint as word_chars from words group by doc_id),
m as (select d.doc_id, coalesce(tot.n_words, 0) as n_words, coalesce(tot.word_chars, 0) as word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(dup.n, 0) as n_dup_lines, coalesce(s5.n_words, 0) as n_repeat_words, coalesce(dup.chars, 0) as dup_line_chars, {", ".join(f"coalesce(s{n}.chars, 0) as dup_chars_{n}" for n in quality.NGRAM_SHARE)}
  from documents d left join tot using (doc_id) left join dup using (doc_id) {" ".join(f"left join s{n} using (doc_id)" for n in quality.NGRAM_SHARE)}),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select *, not base_failed and {_SHARES} as kept from f
"""


OP8_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from w)),
n as (select doc_id, count(*) as n from sh group by doc_id),
sized as (select * from sh join n using (doc_id)),
links as (select a.doc_id as a, b.doc_id as b from sized a join sized b on a.s = b.s and a.doc_id < b.doc_id and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
sym as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, sym.b from reach join sym on reach.b = sym.a),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, component_id = doc_id as kept from c left join n using (doc_id)
"""


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, _tokenizer("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_table(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("found")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("word_bpe_49k.json")).drop("ids")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), words=repeats.WORDS)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("passages").alias("text"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, PATTERN, steady=True)
    return byte_bpe.decode(encoded, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.lloyd(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


_WORDS11 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
with d as (select doc_id, {_WORDS11} as w from documents),
b as (select item_id::varchar as item, w, least(len(w), 10) as n from (select item_id, {_WORDS11} as w from benchmark) where len(w) > 0),
win as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as win from (select *, unnest(range(1, len(w) - n + 2)) as i from b)),
hit as (select distinct doc_id, i, n, item from (select doc_id, i, k.n, array_to_string(w[i : i + k.n - 1], ' ') as win from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), (select distinct n from b) k where i + k.n - 1 <= len(w)) join win using (n, win)),
inside as (select doc_id, count(distinct i + j) as n_hit from (select doc_id, i, unnest(range(n)) as j from hit) group by doc_id),
items as (select doc_id, count(*) filter (item is not null) as n_items, sha256(coalesce(string_agg(item, ',' order by item), '')) as items_sha256 from (select distinct doc_id, item from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from d left join inside using (doc_id) left join items using (doc_id)
"""


def _rounds(n: int) -> str:
    """CTEs of Lloyd's rounds: a0 to a{n} assign, c1 to c{n} move."""
    assign = "a{0} as (select vec_id, min(row(distance, num)) as best from (select vec_id, num, list_sum(list_transform(range(1, 65), lambda j: (v.q[j] - c.q[j]) * (v.q[j] - c.q[j])))::bigint as distance from v, c{0} c) group by vec_id)"
    floor = "(s - ((s % n) + n) % n) // n"
    move = (
        "c{1} as (select num, coalesce(m.q, c.q) as q from c{0} c left join (select num, list(" + floor + " order by j) as q from (select best[2] as num, j, sum(q[j])::bigint as s, count(*) as n "
        "from (select best, q, unnest(range(1, 65)) as j from a{0} join v using (vec_id)) group by all) group by num) m using (num))"
    )
    return ", ".join([x for i in range(n) for x in (assign.format(i), move.format(i, i + 1))] + [assign.format(n)])


OP12_SQL = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by sha256('2:' || vec_id::varchar)) - 1 as num, q from v qualify num < 40),
{_rounds(5)},
r as (select vec_id, best[2]::int as cluster, best[1] as distance from a5)
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(c5.q, ',')) as centroid_sha256 from r join c5 on c5.num = r.cluster
"""


OP13_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from p),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 6) r(k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) as a from g group by all),
t as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and a >= 100),
inner_ as (select distinct lang, array_to_string(w[i : i + m - 1], ' ') as phrase, a from (select lang, string_split(phrase, ' ') as w, a, m, unnest(range(1, k - m + 2)) as i from c, range(2, 5) r(m) where m < k)),
alive as (select c.* from c where not exists (select 1 from inner_ i where i.lang = c.lang and i.phrase = c.phrase and i.a >= c.a)),
cut as (select lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') as head, array_to_string(string_split(phrase, ' ')[j + 1 :], ' ') as rest from (select *, unnest(range(1, k)) as j from alive)),
s as (select cut.lang, cut.phrase, cut.a, j, h.a as l, r.a as r, n, ((1000::hugeint * cut.a * n) // (h.a::hugeint * r.a))::bigint as score
  from cut join f h on h.lang = cut.lang and h.phrase = head join f r on r.lang = cut.lang and r.phrase = rest join t on t.lang = cut.lang),
weak as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from weak qualify rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_ann": op4_ann,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_near_dedup": op8_near_dedup,
    "op9_repeats": op9_repeats,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_decontamination": op11_decontamination,
    "op12_clusters": op12_clusters,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": OP1_SQL,
    "op5_quality_rules": OP5_SQL,
    "op8_near_dedup": OP8_SQL,
    "op11_decontamination": OP11_SQL,
    "op12_clusters": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
