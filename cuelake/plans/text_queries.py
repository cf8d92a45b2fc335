"""Queries of row cleaning, classification and transcripts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import text as T
from cuelake.plans import bindings as B
from cuelake.plans.bindings import with_ctes
from cuelake.sources import tracks

QUERIES, ORACLES = {}, {}


def query(name: str, ctes: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_ctes(ctes, sql) if ctes else sql
        return f

    return add


@query("p09_normalise_flags", "", """
with m as (select event_id, ['TRUE', ' yes', 'off', 'maybe', '', null, '1', 'None'][event_id % 8 + 1] as spotting, case when event_id % 3 = 0 then 'on' when event_id % 3 = 1 then 'nah' end as render, ['clean', 'Faithful ', 'odd'][event_id % 3 + 1] as style from events),
n as (select *, lower(trim(spotting)) as s, lower(trim(render)) as r, lower(trim(style)) as y from m)
select event_id, coalesce(s in ('true', '1', 'yes', 'on', 't', 'y'), false) as spotting, coalesce(r in ('true', '1', 'yes', 'on', 't', 'y'), false) as render, case when y in ('clean', 'faithful') then y else 'clean' end as style,
       cast(coalesce(s not in ('true', '1', 'yes', 'on', 't', 'y', 'false', '0', 'no', 'off', 'f', 'n', 'none', 'null', ''), false) as int) + cast(coalesce(r not in ('true', '1', 'yes', 'on', 't', 'y', 'false', '0', 'no', 'off', 'f', 'n', 'none', 'null', ''), false) as int) as unparsed from n""")
def p09(spark, sf):
    pick = lambda xs, n: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("event_id") % n + 1).cast("int"))
    m = B.table(spark, sf, "events").select("event_id", pick(["TRUE", " yes", "off", "maybe", "", None, "1", "None"], 8).alias("spotting"), pick(["on", "nah", None], 3).alias("render"), pick(["clean", "Faithful ", "odd"], 3).alias("style"))
    return T.normalise_flags(m, ["spotting", "render"], "style")


@query("p11_language_profile", "", """
with l(base, language, rtl) as (values ('en', 'English', false), ('fr', 'French', false), ('de', 'German', false), ('es', 'Spanish', false))
select doc_id, lang as base, language, coalesce(rtl, false) as rtl, coalesce(lang = 'de', false) as to_german, 'en' as primer from documents left join l on lang = base""")
def p11(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.concat(F.lit(" "), F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "_XX").otherwise("-yy")).alias("code"))
    return T.language_profile(d, "code").select("doc_id", "base", "language", "rtl", T.same_language(F.col("code"), F.lit("de-AT")).alias("to_german"), T.primer_language(F.col("code")).alias("primer"))


@query("p12_language_demand", "", """
select lang, count(*) as requests from (select ['he', 'en', 'fr', 'en'][event_id % 4 + 1] as lang from events) group by 1""")
def p12(spark, sf):
    headers = F.array(F.lit("he-IL,he;q=0.9,en;q=0.8"), F.lit("xx,en-US;q=0.5,fr;q=0.4"), F.lit("de;q=0.2, fr;q=0.9,en;q=0.9"), F.lit("zz;q=1"))
    e = B.table(spark, sf, "events").select(F.element_at(headers, (F.col("event_id") % 4 + 1).cast("int")).alias("header"))
    return e.groupBy(T.preferred_language(F.col("header"), ["en", "he", "fr", "de"]).alias("lang")).agg(F.count("*").alias("requests"))


@query("p13_range_check", "", """
with v as (select l_orderkey, l_linenumber, case when l_linenumber = 3 then 'many' else cast(cast(l_quantity as integer) as varchar) end as q from lineitem), c as (select *, try_cast(q as integer) as n from v)
select l_orderkey, l_linenumber, case when n is null or n < 5 or n > 40 then 20 else n end as value,
       case when n is null then 'Invalid integer value: ' || q when n < 5 then 'Value ' || n || ' is below minimum 5' when n > 40 then 'Value ' || n || ' exceeds maximum 40' end as error from c""")
def p13(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, "many").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("q"))
    return T.range_check(li, "q", 20, 5, 40).drop("q")


@query("p14_parse_clock", "", """
with c as (select event_id, event_id % 90 as a, event_id % 70 as b from events)
select event_id, case when event_id % 6 = 0 then a when event_id % 6 = 1 and b <= 59 then a * 60 + b when event_id % 6 = 2 and b <= 59 then 3600 + 60 + b end as seconds,
       case when event_id % 6 in (1, 2) and b > 59 then 'range' when event_id % 6 = 3 then 'number' when event_id % 6 = 4 then 'empty' when event_id % 6 = 5 then 'format' end as reason from c""")
def p14(spark, sf):
    a, b, k = (F.col("event_id") % 90).cast("string"), (F.col("event_id") % 70).cast("string"), F.col("event_id") % 6
    clock = F.when(k == 0, a).when(k == 1, F.concat(a, F.lit(":"), b)).when(k == 2, F.concat(F.lit("01:01:"), b)).when(k == 3, "1:x").when(k == 4, " ").otherwise("1:2:3:4")
    return T.parse_clock(B.table(spark, sf, "events").select("event_id", clock.alias("clock")), "clock").select("event_id", "seconds", "reason")


@query("p15_key_collisions", "", """
with n as (select distinct name from (select p_name || case when p_partkey % 3 = 0 then ' !' else '' end as name from part union all select replace(p_name, ' ', '__') from part where p_partkey % 4 = 0)),
k as (select name, rtrim(substr(regexp_replace(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_\\s.-]', '_', 'g'), '[\\s_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 100), '_') as key from n)
select key, count(*) as names, min(name) as first_name from k group by 1 having count(*) > 1""")
def p15(spark, sf):
    p = B.table(spark, sf, "part")
    names = p.select(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " !").otherwise("")).alias("name")).union(p.where("p_partkey % 4 = 0").select(F.replace("p_name", F.lit(" "), F.lit("__"))))
    return T.key_collisions(names, "name")


@query("p16_check_urls", "", """
with u as (select page_id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path from pages)
select page_id, host, case when host not in ('tionsh.example.net', 'www.thering.example.org', 'therha.example.net') then false when host = 'tionsh.example.net' then path like '%/watch%' or regexp_extract(url, '[?&]v=([^&#]*)', 1) <> '' or path like '%/shorts/%' when host = 'therha.example.net' then length(path) >= 2 else true end as allowed,
       case when host = 'therha.example.net' then string_split(path, '/')[-1] when regexp_extract(url, '[?&]v=([^&#]*)', 1) <> '' then regexp_extract(url, '[?&]v=([^&#]*)', 1) else url end as cache_key from u""")
def p16(spark, sf):
    return T.check_urls(B.table(spark, sf, "pages").select("page_id", "url"), ["tionsh.example.net", "www.thering.example.org", "therha.example.net"], ["tionsh.example.net"], ["therha.example.net"]).drop("url", "playlist")


@query("p17_classify_errors", "", """
with m as (select conv_id, turn, lower(['Sign in to confirm: ', 'HTTP 404 ', 'Connection reset ', 'please log in ', ''][turn % 5 + 1] || text) as m from conversations)
select conv_id, turn, case when regexp_matches(m, 'sign in to confirm|bot') then 'bot' when regexp_matches(m, 'private|unavailable|404|not found') then 'access' when regexp_matches(m, 'network|timeout|connection') then 'network' else 'other' end as code,
       case when regexp_matches(m, 'log in|logged-in|cookies|account') then 'needs_login' when regexp_matches(m, 'unsupported url|unable to extract|no video') then 'no_video' else 'unavailable' end as reason, regexp_matches(m, '429|5[0-9][0-9]|timeout|connection') as retryable from m""")
def p17(spark, sf):
    heads = F.array(*(F.lit(x) for x in ("Sign in to confirm: ", "HTTP 404 ", "Connection reset ", "please log in ", "")))
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.element_at(heads, (F.col("turn") % 5 + 1).cast("int")), "text").alias("message"))
    return T.classify_errors(c, "message").drop("message")


@query("p20_token_estimates", "", """
with t as (select doc_id, len(regexp_extract_all(text, '\\S+')) * 13 // 10 as tokens_in from documents), o as (select *, least(tokens_in * 8 // 10 + 200, tokens_in + 500) as tokens_out from t)
select doc_id, tokens_in, tokens_out, round((tokens_in + 4 * tokens_out) * 0.15::double / 1000000, 9) as cost_usd from o""")
def p20(spark, sf):
    return T.token_estimates(B.table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query("a11_punctuation_health", "segments", """
select video_id, cast(sum(len(regexp_extract_all(text, '[.!?]'))) as bigint) as stops, cast(sum(len(regexp_extract_all(text, ','))) as bigint) as commas, cast(sum(len(regexp_extract_all(text, '[A-Z]'))) as bigint) as capitals,
       cast(sum(length(text)) as bigint) as chars, sum(len(regexp_extract_all(text, '[.!?]'))) = 0 as unpunctuated from segments group by 1""")
def a11(spark, sf):
    return T.punctuation_health(B.segments(spark, sf))


@query("j08_glossary_check", "cues", """
with terms as (
  select distinct substr(string_split(p_name, ' ')[1], 1, 3) as term, upper(reverse(substr(string_split(p_name, ' ')[1], 1, 3))) as rendering from part
  union select * from (values ('the', 'DER'), ('of the', 'VON'), ('UND', 'and'), ('la', 'THE'), ('é', 'E'), ('.', '.'), ('zzz', 'y')) t(term, rendering)
)
select distinct video_id, cue_id, term, rendering from cues, terms where contains(lower(text), lower(term)) and not contains(lower(translated_text), lower(rendering))""")
def j08(spark, sf):
    """Terms from names of parts, whole words, parts of words and marks."""
    term = F.substring(F.split("p_name", " ")[0], 1, 3)
    parts = B.table(spark, sf, "part").select(term.alias("term"), F.upper(F.reverse(term)).alias("rendering"))
    fixed = spark.createDataFrame([("the", "DER"), ("of the", "VON"), ("UND", "and"), ("la", "THE"), ("é", "E"), (".", "."), ("zzz", "y")], "term string, rendering string")
    return T.glossary_check(B.cues(spark, sf), parts.union(fixed))


def stamp(s):
    """MM:SS, from an hour on HH:MM:SS."""
    return F.when(s < 3600, F.format_string("%02d:%02d", F.floor(s / 60), s % 60)).otherwise(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


@query("s06_ranged_transcripts", "segments", """
select video_id, cast(row_number() over (partition by video_id order by pos) as integer) as entry, pos * 3 as start_s, pos * 3 + 2 as end_s, trim(text) as text from segments where pos % 5 <> 2""")
def s06(spark, sf):
    s = B.segments(spark, sf)
    line = F.when(F.col("pos") % 5 == 2, F.concat(F.lit("[bad] "), "text")).otherwise(F.concat(F.lit(" ["), stamp(F.col("pos") * 3), F.lit(" - "), stamp(F.col("pos") * 3 + 2), F.lit("] "), "text"))
    docs = s.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return tracks.read_ranged_transcripts(docs)[0]


@query("s07_stamped_transcripts", "segments", """
with m as (select video_id, pos, pos * 4 as start_s, trim(replace(text, '[', '(')) as text from segments), e as (
  select *, row_number() over (partition by video_id order by pos) - 1 as k, coalesce(lead(start_s) over (partition by video_id order by pos), least(start_s + 5, 1000000)) as end_s from m)
select video_id, cast(k as integer) as pos, cast(start_s as bigint) as start_s, cast(end_s as bigint) as end_s, text from e""")
def s07(spark, sf):
    line = F.concat(F.lit("["), stamp(F.col("pos") * 4), F.lit("] "), F.trim(F.replace("text", F.lit("["), F.lit("("))))
    docs = B.segments(spark, sf, dealt=True).groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return tracks.read_stamped_transcripts(docs.withColumn("duration_s", F.lit(1_000_000).cast("bigint")))


@query("j10_message_lookup", "", """
select s_suppkey, case when s_nationkey % 3 = 0 then n_name when s_nationkey % 3 = 1 then 'EN ' || n_name else 'nation:' || s_nationkey end as message from supplier join nation on s_nationkey = n_nationkey""")
def j10(spark, sf):
    from cuelake.operators.lookup import message_lookup

    n = B.table(spark, sf, "nation")
    messages = n.where("n_nationkey % 3 = 0").select(F.lit("he").alias("lang"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("message")).union(n.where("n_nationkey % 3 = 1").select(F.lit("en"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")), F.concat(F.lit("EN "), "n_name")))
    s = B.table(spark, sf, "supplier").select("s_suppkey", F.lit("he").alias("lang"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("key"))
    return message_lookup(s, messages).select("s_suppkey", "message")


@query("p06_repair_typography")
def p06(spark, sf):
    return T.repair_typography(hebrew(spark, sf), "text")


@query("p07_isolate_bidi")
def p07(spark, sf):
    return T.isolate_bidi(hebrew(spark, sf), "text")


def hebrew(spark, sf):
    """Segments written in Hebrew letters, with quotes and marks put in by position."""
    t = F.translate(F.lower("text"), "abcdefghijklmnopqrstuv", "אבגדהוזחטיכלמנסעפצקרשת")
    return B.segments(spark, sf).select("video_id", "pos", F.when(F.col("pos") % 3 == 0, F.concat(F.lit('"'), t, F.lit('" 12% OK'))).when(F.col("pos") % 3 == 1, F.concat(F.substring(t, 1, 2), F.lit('"'), F.substr(t, F.lit(3)))).otherwise(t).alias("text"))


@query("p08_mark_rtl")
def p08(spark, sf):
    return T.mark_rtl(hebrew(spark, sf), "text")


WORDS_TRUE, WORDS_FALSE = "'true', '1', 'yes', 'on', 't', 'y'", "'false', '0', 'no', 'off', 'f', 'n', 'none', 'null', ''"


@query("p09_unparsed_by_flag", "", f"""
with m as (select ['TRUE', ' yes', 'off', 'maybe', '', null, '1', 'None'][event_id % 8 + 1] as spotting, ['clean', 'Faithful ', 'odd', null][event_id % 4 + 1] as style, case when event_id % 5 = 0 then 'fast' when event_id % 7 = 0 then '' else cast(value as varchar) end as speed from events)
select 'spotting' as flag, count(spotting) as given, count(*) filter (lower(trim(spotting)) not in ({WORDS_TRUE}, {WORDS_FALSE})) as unparsed from m
union all select 'speed', count(speed), count(*) filter (trim(speed) <> '' and try_cast(trim(speed) as double) is null) from m
union all select 'style', count(style), count(*) filter (trim(style) <> '' and lower(trim(style)) not in ('clean', 'faithful')) from m""")
def p09_counts(spark, sf):
    pick = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("event_id") % len(xs) + 1).cast("int"))
    speed = F.when(F.col("event_id") % 5 == 0, "fast").when(F.col("event_id") % 7 == 0, "").otherwise(F.col("value").cast("string"))
    m = B.table(spark, sf, "events").select(pick(["TRUE", " yes", "off", "maybe", "", None, "1", "None"]).alias("spotting"), pick(["clean", "Faithful ", "odd", None]).alias("style"), speed.alias("speed"))
    return T.unparsed_by_flag(m, ["spotting"], "style", ["speed"])


@query("p13_range_report", "", """
with v as (select case when l_linenumber = 3 then 'many' when l_linenumber = 5 then null else cast(cast(l_quantity as integer) as varchar) end as q, cast(l_linenumber as varchar) as n from lineitem)
select 'q in 5..40' as rule, count(q) as given, count(*) filter (q is not null and try_cast(q as integer) is null) as not_integer, count(*) filter (try_cast(q as integer) < 5) as below, count(*) filter (try_cast(q as integer) > 40) as above from v
union all select 'n in 2..6', count(n), 0, count(*) filter (cast(n as integer) < 2), count(*) filter (cast(n as integer) > 6) from v""")
def p13_report(spark, sf):
    q = F.when(F.col("l_linenumber") == 3, "many").when(F.col("l_linenumber") != 5, F.col("l_quantity").cast("int").cast("string"))
    return T.range_report(B.table(spark, sf, "lineitem").select(q.alias("q"), F.col("l_linenumber").cast("string").alias("n")), [("q", 5, 40), ("n", 2, 6)])


CLOCKS = """select event_id, case event_id % 5 when 0 then (event_id % 90) || '.5' when 1 then (event_id % 90) || ':' || (event_id % 70) || '.25' when 2 then '1:2:3:4' when 3 then ' ' else '1:x' end as a, cast(event_id % 70 as varchar) as b from events"""


def clocks(spark, sf):
    e = F.col("event_id")
    s = lambda n: (e % n).cast("string")
    a = F.when(e % 5 == 0, F.concat(s(90), F.lit(".5"))).when(e % 5 == 1, F.concat(s(90), F.lit(":"), s(70), F.lit(".25"))).when(e % 5 == 2, "1:2:3:4").when(e % 5 == 3, " ").otherwise("1:x")
    return B.table(spark, sf, "events").select("event_id", a.alias("a"), s(70).alias("b"))


@query("p14_lenient_clocks", "", f"""with c as ({CLOCKS})
select event_id, case event_id % 5 when 0 then event_id % 90 + 0.5::double when 1 then 60.0::double * (event_id % 90) + event_id % 70 + 0.25::double end as a, cast(event_id % 70 as double) as b from c""")
def p14_lenient(spark, sf):
    return T.parse_clock_columns(clocks(spark, sf), "event_id", ["a", "b"], lenient=True)[0]


@query("p14_clock_rejects", "", f"""with c as ({CLOCKS})
select event_id as key, 'a' as "column", a as value, case event_id % 5 when 2 then 'format' when 3 then 'empty' else 'number' end as reason from c""")
def p14_rejects(spark, sf):
    """The strict form takes no fractions, so each of these is one."""
    return T.parse_clock_columns(clocks(spark, sf), "event_id", ["a", "b"])[1]


@query("p15_safe_file_names", "", r"""
with n as (select p_partkey, case p_partkey % 4 when 0 then ' ..' || p_name || '?.MP4' when 1 then p_name || repeat('x', 300) || '.mkv' when 2 then 'a/b:' || p_name || '. ' else repeat('y', 260) || p_partkey end as name from part),
s as (select *, regexp_replace(regexp_replace(name, '[<>:"/\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') as safe from n)
select p_partkey, case when length(safe) <= 255 then safe when position('.' in safe) = 0 then substr(safe, 1, 255) else substr(safe, 1, 251) || '.mkv' end as safe, lower(string_split(name, '.')[-1]) in ('mp4', 'mkv') and contains(name, '.') as allowed from s""")
def p15_safe(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit(" .."), "p_name", F.lit("?.MP4"))).when(k % 4 == 1, F.concat("p_name", F.lit("x" * 300 + ".mkv"))).when(k % 4 == 2, F.concat(F.lit("a/b:"), "p_name", F.lit(". "))).otherwise(F.concat(F.lit("y" * 260), k.cast("string")))
    return B.table(spark, sf, "part").select("p_partkey", T.safe_file_name(name).alias("safe"), T.allowed_extension(name, ["mp4", "mkv"]).alias("allowed"))


@query("p16_playlists", "", """
with u as (select page_id, url || case page_id % 3 when 0 then '?list=a&index=2' when 1 then '?list=b' else '' end as url from pages)
select page_id, case when contains(url, 'list=') and contains(url, '&index=') then 'selected' when contains(url, 'list=') then 'one' end as playlist from u""")
def p16_lists(spark, sf):
    k = F.col("page_id") % 3
    url = F.concat("url", F.when(k == 0, "?list=a&index=2").when(k == 1, "?list=b").otherwise(""))
    return T.check_urls(B.table(spark, sf, "pages").select("page_id", url.alias("url")), [], [], []).select("page_id", "playlist")
