"""Registered queries over whole corpora: distinct titles and the best documents of each claim."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import lexicon as L
from factloom.operators import retrieval, titles
from factloom.queries import DEDUP_SQL, RESULTS, listed, register, table

#: Titles are texts' first words, here for a claim per source; every seventh url is that of the document before, some are empty.
TITLES = ("select * from (select source claim_id, doc_id job_order, 0 ord, case when doc_id % 50 = 3 then '' else 'https://site.com/' || (doc_id - case when doc_id % 7 = 6 then 1 else 0 end) end url, "
          "array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:14], ' ') title from documents) where url <> ''")


@register(DEDUP_SQL.replace(f"select {', '.join(RESULTS)} from orders", TITLES).replace("claim_id = ", "claim_id is not distinct from ").replace("using (claim_id, rn)", "on o.rn = f.rn and o.claim_id is not distinct from f.claim_id"))
def corpus_titles(spark, sf_dir):
    """The documents whose first words are no near-copy of an earlier document's of their source."""
    url = F.concat(F.lit("https://site.com/"), (F.col("doc_id") - F.when(F.col("doc_id") % 7 == 6, 1).otherwise(0)).cast("string"))
    title = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), 1, 14), " ")
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("claim_id"), F.col("doc_id").alias("job_order"), F.lit(0).alias("ord"), F.when(F.col("doc_id") % 50 == 3, "").otherwise(url).alias("url"), title.alias("title"))
    return titles.distinct_titles(rows, "claim_id").select("claim_id", "url", "job_order", "ord", "title")


def words_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda w: length(w) > 2 and not list_contains({listed(L.RELEVANCE_STOPWORDS)}, w)))"


@register(f"""
with c as (select item_id claim_id, unnest({words_sql('text')}) word from benchmark),
p as (select doc_id, unnest({words_sql('text')}) word from documents),
n as (select word, count(*) df from p group by 1),
w as (select c.claim_id, c.word, round(ln(1 + (select count(distinct doc_id) from documents)::double / df) * {retrieval.SCALE})::bigint weight from c join n using (word)),
s as (select claim_id, doc_id, sum(weight)::bigint score from w join p using (word) group by all),
r as (select *, row_number() over (partition by claim_id order by score desc, doc_id) rank from s)
select claim_id, doc_id, score, rank from r where rank <= 10
""")
def corpus_documents(spark, sf_dir):
    """The ten documents that say most about each test item."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.regexp_extract_all(lowered, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*L.RELEVANCE_STOPWORDS))
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), words.alias("words"))
    return retrieval.corpus_top(claims, table(spark, sf_dir, "documents").select("doc_id", words.alias("words")), 10)
