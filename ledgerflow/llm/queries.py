"""One query for each corpus operator, with its production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import audit, clusters, fingerprint, html, mixing, neighbours, packing, quality, rules, sharding, simhash, suffix, toxicity
from ledgerflow.llm.common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_with_edit(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.check(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = (op1_nearest_neighbours, op2_html_extraction, op3_document_fingerprints, op4_simhash_near_dedup, op5_sharding, op6_source_mixing, op7_quality_classifier, op8_suffix_array_dedup, op9_toxicity, op10_sequence_packing, op11_quality_rules, op12_centroid_clustering, op13_filter_audit)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _mixing_sql() -> str:
    """The raking of mixing.rake, one step of one margin after the other."""
    share = lambda rest: f"(n - length({rest}))::double / n"
    symbols = "text"
    for c in "*#$%&":
        symbols = f"replace({symbols}, '{c}', '')"
    rest = {"|": "replace(text, '|', '')", "symbols": symbols, "upper": "regexp_replace(text, '[A-Z]+', '', 'g')"}
    parts = [
        "t as (select doc_id, source, lang, text, length(text) as n, case when doc_id is null then md5(text) end as h from documents)",
        f"""d as (select doc_id, source, lang, h, coalesce(source, '') as s, coalesce(lang, '') as l, case when n > 0 then strlen(text) - strlen(replace(replace(text, ' ', ''), chr(10), '')) + 1 else 0 end::bigint as tokens,
        case when coalesce(n, 0) = 0 then 'empty' when {share(rest["|"])} > 0.03 then 'table' when {share(rest["symbols"])} > 0.05 then 'symbols' when {share(rest["upper"])} > 0.3 then 'shouting'
        when n < 600 then 'note' when n < 5000 then 'article' else 'long' end as topic from t)""",
        f"f0 as materialized (select s as source, l as lang, topic, sum(tokens)::double as w, {mixing.RATE}::double as p from d group by all having sum(tokens) > 0)",
        f"goal as (select sum(w) * {mixing.RATE} as goal from f0)",
    ]
    for dim in mixing.DIMENSIONS:
        parts.append(f"m_{dim} as materialized (select {dim}, t / sum(t) over () as target from (select {dim}, pow(sum(w), {mixing.FLATTEN[dim]}) as t from f0 group by {dim}))")
    last = "f0"
    for i in range(mixing.ROUNDS):
        for dim in mixing.DIMENSIONS:
            name = f"f{i}_{dim}"
            parts.append(f"{name} as materialized (select f.source, f.lang, f.topic, f.w, least(1.0, f.p * (m.target * g.goal / n.now)) as p from {last} f join m_{dim} m using ({dim}) join (select {dim}, sum(w * p) as now from {last} group by {dim}) n using ({dim}), goal g)")
            last = name
    return (
        "with " + ",\n".join(parts) + f"""
        select doc_id, d.source, d.lang, d.topic, tokens, round(coalesce(f.p, 0.0), 6) as probability, (('0x' || substr(md5(coalesce(doc_id::varchar, h, '') || ':{mixing.SEED}'), 1, 12))::bigint / {1 << 48}.0::double) < coalesce(f.p, 0.0) as kept
        from d left join {last} f on f.source = d.s and f.lang = d.l and f.topic = d.topic"""
    )


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _rules_sql() -> str:
    """Words, windows and lines as rows; the distances from lists."""
    n, m = len(rules.CLASSES), rules.COMMON
    taken = {"lower": "[a-z]", "blank": r"[\x20\x09-\x0D]", "upper": "[A-Z]", "symbol": "[#*$%&|<>]", "digit": "[0-9]", "point": r"[!\x22'()+,\-./:;=?@\[\\\]^_`{}~]"}
    count = lambda pattern: f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))".replace("'()+", "''()+")
    other = "length(text) - " + " - ".join(count(p) for p in taken.values())
    term = lambda a, b: f"case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end"
    far = lambda p, q, size, k: f"sqrt(greatest(0, list_sum(list_transform(range(1, len({q}) + 1), lambda i: {term(f'{p}[i]', f'{q}[i]')} + {term(f'{q}[i]', f'{p}[i]')})) / 2 - (len({q}) - 1) / (8 * ln(2) * {size})))"
    return f"""with d as materialized (select row_number() over () as r, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as w from documents),
    heavy as (select text as copy from d group by text having count(*) >= (select count(*) from d) * {rules.SHARE}),
    x as materialized (select d.*, copy is not null as heavy from d left join heavy on d.text = heavy.copy),
    held as (select lang, word, case when heavy then text end as copy, count(*) as n from (select lang, heavy, text, unnest(list_distinct(list_transform(w, lambda v: lower(v)))) as word from x) group by all),
    df as (select lang, word, sum(case when copy is null then n else 1 end) as n from held group by all),
    ranked as (select lang, word, row_number() over (partition by lang order by n desc, word) as k from df qualify k <= {m}),
    words as materialized (select r, lang, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from x),
    windows as (select r, i, hash(list(word) over (partition by r order by i rows between current row and {rules.WINDOW - 1} following)) as h, count(*) over (partition by r order by i rows between current row and {rules.WINDOW - 1} following) as n from words),
    twice as (select r, i from (select r, i, count(*) over (partition by r, h) as c from windows where n = {rules.WINDOW}) where c > 1),
    covered as (select r, count(distinct i + o)::bigint as n_repeat_words from twice, range({rules.WINDOW}) t(o) group by r),
    lines as (select r, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as line from x) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
    hits as (select words.r, ranked.k, count(*) as c from words join ranked on words.lang = ranked.lang and lower(words.word) = ranked.word group by all),
    listed as (select lang, count(*) as m from ranked group by lang),
    commons as (select x.r, list(coalesce(c, 0) order by g.k) as l, sum(coalesce(c, 0)) as s from x join listed using (lang) join (select unnest(range(1, {m + 1})) as k) g on g.k <= m left join hits on hits.r = x.r and hits.k = g.k group by x.r),
    a as materialized (select x.r, doc_id, lang, text, heavy, length(text) as n_chars, len(w)::bigint as n_words, [{", ".join(count(p) for p in taken.values())}, {other}]::bigint[] as classes, (coalesce(l, []) || [len(w) - coalesce(s, 0)])::bigint[] as commons,
      coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from x left join commons using (r) left join lines using (r) left join covered using (r)),
    once as (select lang, classes, commons from a where not heavy union all (select lang, any_value(classes), any_value(commons) from a where heavy group by lang, text)),
    ref as (select lang, count(*) as texts, [{", ".join(f"sum(classes[{i + 1}])" for i in range(n))}]::double[] as c, list_filter([{", ".join(f"sum(case when len(commons) > {i + 1} then commons[{i + 1}] end)" for i in range(m))}], lambda v: v is not null)::double[] || [sum(commons[len(commons)])::double] as v from once group by lang),
    j as (select a.*, texts, list_transform(c, lambda y: y / list_sum(c)) as c, list_transform(v, lambda y: y / list_sum(v)) as v, list_transform(classes, lambda y: y::double / nullif(list_sum(classes), 0)) as p, list_transform(commons, lambda y: y::double / nullif(list_sum(commons), 0)) as q from a join ref using (lang)),
    z as (select *, case when texts >= {rules.LANGUAGE_TEXTS} and n_chars >= {rules.CLASS_CHARS} then {far("p", "c", "n_chars", n)} end as cd, case when texts >= {rules.LANGUAGE_TEXTS} and n_words >= {rules.COMMON_WORDS} then {far("q", "v", "n_words", m + 1)} end as wd,
      n_words < {rules.LEAST_WORDS} or 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words as base_failed from j)
    select doc_id, n_words, (n_chars - classes[2])::bigint as word_chars, classes[4] as n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(cd <= {rules.CLASS_LIMIT}, true) and coalesce(wd <= {rules.COMMON_LIMIT}, true) as kept,
      round(cd, 6) as class_distance, round(wd, 6) as common_distance from z"""


def _clusters_sql() -> str:
    """Lloyd's rounds over all vectors, one statement after the other, on lists of integers."""
    floor = lambda s, n: f"(({s} - ((({s}) % {n}) + {n}) % {n}) // {n})"
    near = lambda c: f"""select vec_id, q, arg_min(j, d * {clusters.CLUSTERS} + j) as j, min(d) as d from (select r, vec_id, q, j, list_sum(list_transform(range(1, {clusters.DIMENSION + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::hugeint as d from k, {c}) group by r, vec_id, q"""
    parts = [
        f"""k as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({clusters.SCALE} * x::double)::hugeint) as q from embeddings where len(embedding) = {clusters.DIMENSION}
        and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {clusters.DIMENSION})""",
        f"c0 as materialized (select (row_number() over (order by h, q)) - 1 as j, q as c from (select sha256('{clusters.SEED}:' || vec_id) as h, q from k order by h, q limit {clusters.CLUSTERS}))",
    ]
    for i in range(clusters.ROUNDS):
        parts.append(f"a{i} as materialized ({near(f'c{i}')})")
        parts.append(f"s{i} as (select j, o, sum(x)::hugeint as s, count(*) as n from (select j, unnest(q) as x, unnest(range({clusters.DIMENSION})) as o from a{i}) group by j, o)")
        parts.append(f"c{i + 1} as materialized (select c{i}.j, coalesce(v, c) as c from c{i} left join (select j, list({floor('s', 'n')} order by o) as v from s{i} group by j) n using (j))")
    return "with " + ",\n".join(parts) + f""", f as (select *, count(*) over (partition by q) as m from ({near(f"c{clusters.ROUNDS}")}))
    select vec_id, f.j::integer as cluster, d::bigint as distance, (sum(d) over (partition by f.j))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256, m::bigint as multiplicity
    from f join c{clusters.ROUNDS} e on e.j = f.j"""


def _audit_sql() -> str:
    """Every order step by step: each step counts the masks that earlier steps have left."""
    words = _WORDS.format("t")
    return f"""with d as materialized (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
    e as (select *, min(doc_id) over (partition by t) as low from d),
    marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
    f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > low, false)] as fails
      from (select *, {words} as w from e) left join marks using (doc_id)),
    m as materialized (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
    o as (select a || b || c || x || y as filter_order from (values ('A'), ('B'), ('C'), ('D'), ('E')) t1(a), (values ('A'), ('B'), ('C'), ('D'), ('E')) t2(b), (values ('A'), ('B'), ('C'), ('D'), ('E')) t3(c), (values ('A'), ('B'), ('C'), ('D'), ('E')) t4(x), (values ('A'), ('B'), ('C'), ('D'), ('E')) t5(y)
      where len(list_distinct([a, b, c, x, y])) = 5),
    s as (select filter_order, unnest(range(1, 6))::integer as step from o),
    p as (select filter_order, step, substr(filter_order, step, 1) as letter, list_transform(range(1, step), lambda i: instr('ABCDE', substr(filter_order, i::bigint, 1))) as before, instr('ABCDE', letter) as own from s),
    r as (select part, filter_order, step, letter, n, good, toxic, fails[own] as hit, len(list_filter(before, lambda b: fails[b])) > 0 as gone, len(list_filter(fails, lambda v: v)) as k from p, m),
    c as (select part, filter_order, step, letter, sum(case when not gone and not hit then n else 0 end)::bigint as kept, sum(case when not gone and hit then n else 0 end)::bigint as removed, sum(case when gone and hit then n else 0 end)::bigint as redundant,
      sum(case when hit and k = 1 then n else 0 end)::bigint as unique_fails, sum(case when not gone and hit then good else 0 end)::bigint as good_lost, sum(case when not gone and hit then toxic else 0 end)::bigint as toxic_lost from r group by all)
    select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from c"""


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": _mixing_sql(), "op11_quality_rules": _rules_sql(), "op12_centroid_clustering": _clusters_sql(), "op13_filter_audit": _audit_sql()}
