"""The text operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import alignment, exact_dedup, html_main, language, media, mixing, packing, quality, secrets, simhash, token_counts, url_rules, whitening
from partloom.llm.common import table

#: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sounds(table(spark, sf_dir, "documents"), with_pairs=True)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main.main_texts(pages, html_main.learn(pages))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return got.select("doc_id", F.coalesce(language.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return found.withColumn("spans", F.array_join(F.transform("spans", one), ","))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_exact_dedup, op3_packing, op4_quality, op5_media, op6_html, op7_url_rules, op8_language, op9_secrets, op10_mixing,
        op11_whitening, op12_token_counts, op13_alignment,
    )
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


def _fifth_sql(x: str) -> str:
    """The fifth power of x modulo the prime, x being a name or in brackets."""
    m = f"({x} % {mixing.PRIME})"
    return f"(({m} * {m} % {mixing.PRIME}) * ({m} * {m} % {mixing.PRIME}) % {mixing.PRIME} * {m} % {mixing.PRIME})"


def _network_sql(x: str, of: str) -> str:
    """One pass of the permutation on x; later columns of the list use earlier ones."""
    steps = [f"{x} // b as l0", f"{x} % b as r0"]
    left, right = "l0", "r0"
    for i, seed in enumerate(mixing.STEPS):
        key = f"(({right if i % 2 == 0 else left}) + sid * 7919 + turn * 104729 + {seed})"
        name, size, was = (f"l{i + 1}", "a", left) if i % 2 == 0 else (f"r{i + 1}", "b", right)
        steps.append(f"({was} + {_fifth_sql(key)}) % {size} as {name}")
        left, right = (name, right) if i % 2 == 0 else (left, name)
    return f"select sid, slot, turn, shard, blocks, a, b, {left} * b + {right} as x from (select *, {', '.join(steps)} from {of})"


SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from (
            select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
                count(*) over (partition by coalesce(text, '')) as group_size, sha256(coalesce(text, '')) as text_sha256
            from documents)""",
    "op7_url_rules": rf"""
        with rules(host, path, verdict) as (values {_RULES_SQL}),
        split as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        urls as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from split)
        select u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, 'allow') as verdict
        from urls u left join (
            select u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
            from (select distinct host, path from urls) u join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)
            group by u.host, u.path) b on u.host = b.host and u.path = b.path""",
    "op10_mixing": rf"""
        with recursive sized as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % (1 + (select count(*) from documents) // {mixing.BUCKET}) as bucket, md5(coalesce(text, '') || '|' || coalesce(source, '')) as tie from documents),
        sources as (select source, sum(size)::bigint as source_size from sized group by source),
        ranked as (select *, row_number() over (order by source nulls last) as sid, source_size * {mixing.CEILING} as most from sources),
        weighed as (select *, case (sid - 1) % 3 when 0 then {mixing.WEIGHTS[0]} when 1 then {mixing.WEIGHTS[1]} else {mixing.WEIGHTS[2]} end as weight from ranked),
        levels as (select *, (sum(source_size) over () - coalesce(sum(most) over (order by most / weight, sid rows between unbounded preceding and 1 preceding), 0))::double
            / sum(weight) over (order by most / weight, sid rows between current row and unbounded following) as level from weighed),
        flags as (select *, weight * level > most as capped from levels),
        target as (select *, case when capped then most::double else weight * (select arg_min(level, (most / weight, sid)) from flags where not capped) end as target from flags),
        plan as (select sid, source, source_size, target, cast(ceil(source_size / {mixing.BLOCK}) as bigint) as blocks,
            case when source_size > 0 then floor(target * ceil(source_size / {mixing.BLOCK}) / source_size + 0.5)::bigint else 0 end as slots from target),
        placed as (select s.*, p.sid, p.source_size, p.target,
            sum(size) over (partition by p.sid order by bucket, doc_id nulls first, size, tie rows between unbounded preceding and current row)::bigint - size as "offset"
            from sized s join plan p on s.source is not distinct from p.source),
        draws as (select sid, unnest(range(slots)) as i from plan),
        drawn as (select sid, {_fifth_sql("q")} % {mixing.SHARDS} as shard, count(*) as n from (
            select sid, {_fifth_sql(f"(i % {mixing.PRIME} + sid * {mixing.DRAW[0]})")} + i // {mixing.PRIME} + {mixing.DRAW[1]} as q from draws) group by all),
        held as (select *, sum(n) over (partition by sid order by shard)::bigint - n as start from drawn),
        slots as (select sid, shard, start + unnest(range(n)) as slot from held),
        turns as (select sid, shard, slot, blocks, slot // blocks as turn, slot % blocks as x, ceil(sqrt(blocks::double))::bigint as a, (blocks + a - 1) // a as b from slots join plan using (sid)),
        walk as ({_network_sql("x", "turns")} union all {_network_sql("x", "(select * from walk where x >= blocks)")}),
        times as (select sid, x as block, count(*) as times, min(shard) as shard from walk where x < blocks group by all),
        pieces as (select sid, "offset", size, unnest(range("offset" // {mixing.BLOCK}, ("offset" + size - 1) // {mixing.BLOCK} + 1)) as block from placed where size > 0),
        words as (select p.sid, p."offset", sum((least(p."offset" + p.size, (p.block + 1) * {mixing.BLOCK}) - greatest(p."offset", p.block * {mixing.BLOCK})) * t.times)::bigint as taken, min(t.shard) as first_shard
            from pieces p join times t using (sid, block) group by all)
        select d.doc_id, d.size, d.source_size, d.target, coalesce(w.taken, 0)::bigint as taken, coalesce(w.first_shard, -1)::bigint as first_shard
        from placed d left join words w on d.size > 0 and d.sid = w.sid and d."offset" = w."offset" """,
}
