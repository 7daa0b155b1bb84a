"""The registered queries of this package, with the DuckDB text of the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import (
    collocations, decontaminate, divergence, lang_id, lm_score, neighbours, packing, pieces, pii, secrets, simhash, tokens, toxicity,
)
from gazette.llm.common import held_out, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return query

    return add


@register("op1_token_counts")
def _(spark, sf):
    return tokens.count_tokens(load(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@register("op2_sentencepiece")
def _(spark, sf):
    """Whole texts encoded and decoded again."""
    documents = load(spark, sf, "documents").select("doc_id", "text")
    return pieces.encode(documents, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@register("op3_nearest_neighbours")
def _(spark, sf):
    return neighbours.nearest(load(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@register("op4_language_id")
def _(spark, sf):
    documents = load(spark, sf, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    found = lang_id.identify(documents, learn_from=~out)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


@register("op5_secret_scan")
def _(spark, sf):
    return secrets.scan_secrets(load(spark, sf, "documents"))


@register("op6_lm_scores")
def _(spark, sf):
    return lm_score.score_documents(load(spark, sf, "documents"))


@register("op7_simhash_near_duplicates")
def _(spark, sf):
    return simhash.near_duplicates(load(spark, sf, "documents"), shingle=3, seed=42, distance=2)


@register("op8_personal_data")
def _(spark, sf):
    return pii.personal_data(load(spark, sf, "documents"))


@register("op9_toxicity")
def _(spark, sf):
    out = held_out(F.col("doc_id"), 3, 1)
    scored = toxicity.score_toxicity(load(spark, sf, "documents"), load(spark, sf, "labels").filter(~out))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted", "spans")


@register("op10_benchmark_decontamination")
def _(spark, sf):
    return decontaminate.benchmark_hits(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


@register("op11_harmonic_packing")
def _(spark, sf):
    return packing.pack_documents(load(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


@register("op12_source_divergence", """
    with d as (
        select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
        from documents
    ), t as (select row, lang, source, unnest(terms) as term from d),
    kept as (select lang, term, count(*)::hugeint as all_n from t group by lang, term having count(distinct row) >= 10),
    g as (select distinct lang, source from d),
    own as (select lang, source, term, count(*)::hugeint as n from t semi join kept using (lang, term) group by lang, source, term),
    v as (select lang, count(*)::hugeint as v, sum(all_n)::hugeint as total from kept group by lang),
    n as (select lang, source, sum(n)::hugeint as total from own group by lang, source),
    p as (
        select g.lang, g.source, kept.term, coalesce(own.n, 0) as n,
               1 + (1000000000::hugeint * (coalesce(own.n, 0) + 2)) // (coalesce(n.total, 0) + 2 * v.v) as p,
               1 + (1000000000::hugeint * (kept.all_n + 2)) // (v.total + 2 * v.v) as q
        from g join kept using (lang) join v using (lang) left join n using (lang, source) left join own using (lang, source, term)
    ), pairs as (
        select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
        from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
    ), parts as (
        select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pairs.value, 0)::bigint as value
        from g a join g b on a.lang = b.lang and a.source <> b.source
        left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
        union all
        select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q
    )
    select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
    from parts qualify part = 'pair' or rank <= 10
""")
def _(spark, sf):
    return divergence.source_divergence(load(spark, sf, "documents"), least_docs=10, top=10)


@register("op13_phrase_collocations", """
    with pieces as (
        select coalesce(lang, 'und') as lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\\x0A-\\x0D]')) as piece
        from documents
    ), w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as words from pieces),
    places as (select lang, words, unnest(range(1, len(words) + 1)) as i from w),
    phrases as (
        select lang, words[i:i + m - 1] as phrase from places cross join (values (1), (2), (3)) sizes(m) where i + m - 1 <= len(words)
    ), f as (select lang, phrase, count(*)::hugeint as f from phrases group by lang, phrase),
    n as (select lang, sum(f)::bigint as n from f where len(phrase) = 1 group by lang),
    candidates as (select lang, phrase, f as a from f where len(phrase) > 1 and f >= 10),
    cuts as (
        select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, (1000000::hugeint * c.a * c.a) // (l.f * r.f) as score
        from (select *, unnest(range(1, len(phrase))) as k from candidates) c
        join f l on l.lang = c.lang and l.phrase = c.phrase[1:k] join f r on r.lang = c.lang and r.phrase = c.phrase[k + 1:]
    ), best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    inside as (
        select lang, phrase, max(a) as longest
        from (select lang, unnest([phrase[1:2], phrase[2:3]]) as phrase, a from candidates where len(phrase) = 3) group by lang, phrase
    ), ranked as (
        select b.lang, array_to_string(b.phrase, ' ') as phrase, b.a, b.l, b.r, b.score
        from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase and 100 * i.longest >= 50 * b.a where i.lang is null
    )
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
           a::bigint as a, l::bigint as l, r::bigint as r, n.n, score::bigint as score
    from ranked join n using (lang) qualify rank <= 2000
""")
def _(spark, sf):
    return collocations.collocations(load(spark, sf, "documents"), least=10, top=2000, cover=50)
