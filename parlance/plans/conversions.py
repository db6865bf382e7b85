"""The named query for conversion by a large dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import conversion
from parlance.plans.adapters import table
from parlance.plans.catalogue import query


def phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark, and pairs of them, with what they turn into."""
    w = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))
    phrases = w.select(F.explode(F.concat("w", pairs)).alias("source")).distinct().where("length(source) >= 3")
    return phrases.select("source", F.concat(F.lit("<"), F.upper(F.translate("source", " ", "_")), F.lit(">")).alias("target"))


@query(r"""with recursive w as (select regexp_extract_all(text, '[A-Za-z]+') as w from benchmark), p as (select distinct unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as source from w),
 d as (select source, '<' || upper(replace(source, ' ', '_')) || '>' as target from p where length(source) >= 3), n as (select distinct length(source) as n from d), c as (select row_number() over () as r, conv_id, turn, text from conversations where text is not null),
 m as (select r, i, max_by(target, n) as target, max(n) as n from (select r, i, n, substr(text, i, n) as s from (select r, text, unnest(range(1, length(text) + 1)) as i from c), n where i + n - 1 <= length(text)) x join d on d.source = x.s group by r, i),
 e as (select m.*, x.i as following from m asof left join (select r, i from m) x on m.r = x.r and m.i + m.n <= x.i),
 g(r, i) as (select r, min(i) from m group by r union all select e.r, e.following from g join e using (r, i) where e.following is not null),
 t as (select c.r, string_agg(e.target || substr(text, i + n, coalesce(following, length(text) + 1) - i - n), '' order by i) as t, min(i) as i from g join e using (r, i) join c using (r) group by c.r)
 select c.conv_id, c.turn, case when t.r is null then text else substr(text, 1, t.i - 1) || t.t end as t from c left join t using (r)""")
def dictionary_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    convert = conversion.converter(spark, conversion.trie_of(phrase_table(spark, sf_dir)))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", convert(F.col("text")).alias("t"))
