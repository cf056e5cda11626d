"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, html, language, licenses, line_dedup, minhash, sentencepiece_bpe, sharding, spelling, suffix_dedup, tiff, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(_table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.find_classes(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.stored_texts(tiff.texts_as_tiff(_table(spark, sf_dir, "documents")))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.assign_shards(_table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digest(sentencepiece_bpe.encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents")).drop("keep")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(_table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_html_text, op3_language, op4_minhash_dedup, op5_suffix_dedup, op6_decontaminate, op7_tiff, op8_feistel_shards, op9_token_counts, op10_sentencepiece, op11_line_dedup, op12_spelling_variants, op13_conversation_repair)}

_SMALL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# crc32 of a string x, with the table of a relation `crc`.
_CRC = "select list(c order by i) tab from (select i, list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i) c from range(256) r(i))"
_CRC_OF = "xor(list_reduce(range(1, octet_length(encode(x)) + 1), lambda c, k: xor(c // 256, tab[1 + xor(c % 256, ('0x' || substr(hex(encode(x)), 2 * k - 1, 2))::bigint)]), 4294967295), 4294967295)"

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op4_minhash_dedup": f"""
with recursive docs as (select doc_id, text, {_WORDS} w from documents),
shingles as (select doc_id, unnest([w[i:i + 4] for i in range(1, len(w) - 3)]) s from docs where len(w) >= 5),
bags as (select doc_id, s, count(*) c from shingles group by 1, 2),
sizes as (select doc_id, sum(c) n from bags group by 1),
common as (select a.doc_id x, b.doc_id y, sum(least(a.c, b.c)) i from bags a join bags b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where i >= 0.8 * (p.n + q.n - i) union select a.doc_id, b.doc_id from docs a join docs b on a.text = b.text and a.doc_id < b.doc_id),
both_ as (select x, y from links union select y, x from links),
reach as (select doc_id, doc_id root from docs union select both_.y, reach.root from reach join both_ on both_.x = reach.doc_id),
classes as (select doc_id, min(root) class_id from reach group by 1)
select doc_id, class_id, count(*) over (partition by class_id) class_size from classes""",
    "op6_decontaminate": f"""
with items as (select cast(item_id as varchar) item, {_WORDS} w from benchmark),
windows as (select distinct item, unnest([w[i:i + least(13, len(w)) - 1] for i in range(1, len(w) - least(13, len(w)) + 2)]) win from items where len(w) > 0),
docs as (select doc_id, {_WORDS} w from documents),
sizes as (select distinct len(win) n from windows),
cut as (select doc_id, n, unnest(range(1, greatest(1, len(w) - n + 2))) p0, w from docs, sizes),
found as (select cut.doc_id, cut.p0, cut.n, windows.item from cut join windows on cut.w[cut.p0:cut.p0 + cut.n - 1] = windows.win),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(p0, p0 + n)) p from found) group by 1),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item from found) group by 1)
select docs.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from docs left join hit using (doc_id) left join its using (doc_id)""",
    "op11_line_dedup": f"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) p from documents),
keyed as (select *, translate(trim(line, {_SPACE}), {_SMALL}) k from lines),
common as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) n_lines, count(common.k) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by p) filter (common.k is null), '')) kept_sha256
from keyed left join common using (k) group by doc_id""",
    "op12_spelling_variants": f"""
with recursive crc as ({_CRC}),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')), {_SMALL}) w from documents),
each as (select coalesce(doc_id::varchar, '') || ':' || w x, w, count(*) c from runs group by 1, 2),
hashed as (select w, c, len(w) size, {_CRC_OF} h from each, crc),
words as (select word, sum(c)::bigint n from (select case when h % 31 = 0 then left(w, (h % size)::integer) || substr(w, (h % size)::integer + 2) else w end word, c from hashed) where len(word) >= 7 group by 1 having sum(c) >= 2),
less as (select word, n, i, left(word, i - 1) || substr(word, i + 1) rest from (select word, n, unnest(range(1, len(word) + 1))::integer i from words)),
pairs as (select a.word, b.word other, b.n n_other from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select less.word, words.word, words.n from less join words on less.rest = words.word union select words.word, less.word, less.n from less join words on less.rest = words.word),
best as (select word, count(*) n_near, min(struct_pack(less := -n_other, other := other)) b from pairs group by 1),
known as (select word, n, coalesce(n_near, 0)::bigint n_near, case when -b.less >= 10 * n then b.other end form, case when -b.less >= 10 * n then -b.less end form_n from words left join best using (word)),
ways as (select word, form root from known where form is not null union all select ways.word, known.form from ways join known on ways.root = known.word where known.form is not null),
ends as (select ways.word, ways.root from ways join known on ways.root = known.word where known.form is null)
select word, form, coalesce(root, word) root, n, n_near, form_n::bigint form_n from known left join ends using (word)""",
    "op13_conversation_repair": f"""
with recursive crc as ({_CRC}),
convs as (select conv_id, row_number() over (order by conv_id) g from (select distinct conv_id from conversations)),
said as (select g, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(c.conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') x from conversations c join convs on c.conv_id is not distinct from convs.conv_id),
hashed as (select *, {_CRC_OF} % 20 d from said, crc),
damaged as (select g, turn, case when d = 4 then 'user' else role end role, case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text from hashed, (values (0), (1)) v(k) where d <> 0 and (k = 0 or d = 3)),
numbered as (select *, row_number() over (partition by g order by turn nulls first, md5(len(role) || ':' || role || text)) i from damaged),
seen as (select *, left(role, 1) c, trim(text, {_SPACE}) bare, row_number() over (partition by g, role, text order by i) > 1 again, lag(left(role, 1)) over (partition by g order by i) || left(role, 1) pair from numbered),
marked as materialized (select *, case when bare = '' then 'b' when again then 'd' when right(bare, 1) not in ('.', '!', '?') then 't' else 'k' end fault from seen),
costed as materialized (select g, i, role, text, c, fault not in ('b', 'd') free, case when fault = 't' then 1 else 0 end e from marked),
sizes as (select g, max(i) n from marked group by 1),
held as materialized (
  select g, n + 1 i, [0, 4, 2, 0]::bigint[] v from sizes
  union all
  select g, i, [least(h[1], 2 + h[3], 4 + h[4]), least(h[2], 2 + h[3], 4 + h[4]), least(h[3], 2 + h[4]), least(h[4], 2 + h[3])] from (
    select r.g, r.i, [
      least(3 + v[1], case when free then 2 + e + v[3] else 99999999 end, case when free and c = 's' then e + v[2] when free and c = 'u' then e + v[3] else 99999999 end),
      least(3 + v[2], case when free then 2 + e + v[3] else 99999999 end, case when free and c = 'u' then e + v[3] else 99999999 end),
      least(3 + v[3], case when free then 2 + e + v[4] else 99999999 end, case when free and c = 'a' then e + v[4] else 99999999 end),
      least(3 + v[4], case when free then 2 + e + v[3] else 99999999 end, case when free and c = 'u' then e + v[3] else 99999999 end)] h
    from held join costed r on r.g = held.g and r.i = held.i - 1)),
steps as materialized (select held.g, held.i, held.v now, nxt.v after, role, text, c, free, e from held left join costed r on r.g = held.g and r.i = held.i left join held nxt on nxt.g = held.g and nxt.i = held.i + 1),
walk as (
  select g, 1::bigint i, 1 s, '' audit, []::varchar[] lines, true going from sizes
  union all
  select g, case when op in ('I', '') then i else i + 1 end, case op when 'K' then case c when 's' then 2 when 'u' then 3 else 4 end when 'D' then s when '' then s else [3, 3, 4, 3][s] end, audit || op,
    case op when 'K' then list_append(lines, role || ':' || text) when 'R' then list_append(lines, [ 'user', 'user', 'assistant', 'user' ][s] || ':' || text) when 'I' then list_append(lines, [ 'user', 'user', 'assistant', 'user' ][s] || ':') else lines end, op <> ''
  from (select w.*, role, text, c, case when after is null then case when now[s] > 0 then 'I' else '' end when now[s] = 3 + after[s] then 'D' when now[s] = 2 + now[[3, 3, 4, 3][s]] then 'I'
      when free and ((c = 's' and s = 1 and now[s] = e + after[2]) or (c = 'u' and s <> 3 and now[s] = e + after[3]) or (c = 'a' and s = 3 and now[s] = e + after[4])) then 'K' else 'R' end op
    from walk w join steps t on t.g = w.g and t.i = w.i where going)),
ends as (select g, audit, lines from walk where not going),
sums as (select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate, count(*) filter (fault = 't') truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal from marked group by 1)
select conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(v[1], 0)::bigint cost, coalesce(audit, '') audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) repaired_sha256
from convs left join sums using (g) left join ends using (g) left join held on held.g = convs.g and held.i = 1""",
}
