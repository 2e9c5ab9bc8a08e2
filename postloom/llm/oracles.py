"""The same results as DuckDB SQL, for the queries that SQL can express on whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


_BLANKS = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = """
with digested as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex
    from pages
), answers as (
    select hex, max(page_id) as answer from digested group by hex
), fives as (
    select hex, answer,
        list_transform(range(0, 8), lambda i: list_reduce(
            list_transform(range(1, 6), lambda j: instr('0123456789abcdef', substr(hex, i * 5 + j, 1)) - 1),
            lambda a, b: a * 16 + b)) as numbers
    from answers
), named as (
    select hex, answer, array_to_string(list_transform(numbers, lambda n:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', n // 32768 + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n // 1024) % 32 + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n // 32) % 32 + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', n % 32 + 1, 1)), '') as payload_digest
    from fives
)
select page_id, payload_bytes, payload_digest,
    case when page_id = answer then 'response' else 'revisit' end as record_type,
    case when page_id <> answer then answer end as refers_to
from digested join named using (hex)
"""

OP2 = f"""
with items as (
    select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({_lower("text")}, '{_ALNUM}') as w
    from benchmark where text is not null
), windows as (
    select distinct item, least(len(w), 10) as k, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') as s
    from items, unnest(range(0, greatest(len(w) - 9, 1))) as t(i) where len(w) > 0
), docs as (
    select row_number() over () as r, doc_id,
        regexp_extract_all({_lower("coalesce(text, '')")}, '{_ALNUM}') as w
    from documents
), grams as (
    select r, k, i, array_to_string(w[i + 1:i + k], ' ') as s
    from docs, (select distinct k from windows) as sizes, unnest(range(0, len(w) - k + 1)) as t(i)
), hits as (
    select r, i, k, item from grams join windows using (k, s)
), words_hit as (
    select r, count(distinct i + j) as n_hit from hits, unnest(range(0, k)) as t(j) group by r
), items_hit as (
    select r, count(*) as n_items, string_agg(item, ',' order by item) as names
    from (select distinct r, item from hits) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
    coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 as contaminated
from docs left join words_hit using (r) left join items_hit using (r)
"""

_ESCAPED = r"regexp_replace(replace({0}, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')"
OP5 = f"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all
    select -7, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) as v(t, r)
), formatted as (
    select *, '<s>' || {_ESCAPED.format("role")} || '[INST]' || {_ESCAPED.format("text")} || '[/INST]</s>' as segment
    from turns
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, segment)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, segment) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(segment)) as bigint) as formatted_chars
from formatted group by conv_id
"""

OP7 = f"""
with recursive docs as (
    select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_BLANKS}') as w from documents
), shingles as (
    select distinct doc_id, array_to_string(w[i + 1:i + 4], ' ') as s
    from docs, unnest(range(0, greatest(len(w) - 3, 1))) as t(i) where len(w) > 0
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as n
    from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), edges as (
    select a, b from links union all select b, a from links
), reach as (
    select doc_id, doc_id as other from docs
    union
    select reach.doc_id, edges.b from reach join edges on reach.other = edges.a
), least as (
    select doc_id, min(other) as component_id from reach group by doc_id
)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from docs join least using (doc_id) left join sizes using (doc_id)
"""

_CELL = "((({0}) >> greatest(length(bin({0})) - 6, 0)) << greatest(length(bin({0})) - 6, 0))"
OP9 = f"""
with docs as (
    select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '{_BLANKS}') as w
    from documents
), lines as (
    select r, count(*) - count(distinct line) as n_dup_lines
    from docs, unnest(string_split(text, chr(10))) as t(line)
    where regexp_matches(line, '{_BLANKS}') group by r
), grams as (
    select r, i, array_to_string(w[i + 1:i + 5], ' ') as s
    from docs, unnest(range(0, len(w) - 4)) as t(i)
), repeated as (
    select r, count(distinct i + j) as n_repeat_words
    from (select *, count(*) over (partition by r, s) as n from grams), unnest(range(0, 5)) as t(j)
    where n > 1 group by r
), counted as (
    select r, doc_id, lang, source, cast(len(w) as bigint) as n_words,
        cast(length(array_to_string(w, '')) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
    from docs left join lines using (r) left join repeated using (r)
), judged as (
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted
), rates as (
    select r, lang, source, base_failed, unnest([
        {{'rate': 'symbols', 'v': n_symbols * 10000 // n_words}},
        {{'rate': 'dup_lines', 'v': n_dup_lines * 10000 // n_words}},
        {{'rate': 'repeats', 'v': n_repeat_words * 10000 // n_words}},
        {{'rate': 'word_length', 'v': word_chars * 10000 // n_words}}], recursive := true)
    from judged where not base_failed
), cells as (
    select lang, source, rate, {_CELL.format("v")} as cell, count(*) as n from rates group by all
), grouped as (
    select 'own' as level, lang, source, rate, cell, n from cells
    union all select 'language', lang, null, rate, cell, sum(n) from cells group by lang, rate, cell
    union all select 'all', null, null, rate, cell, sum(n) from cells group by rate, cell
), ranked as (
    select *, sum(n) over (partition by level, lang, source, rate order by cell) as upto,
        sum(n) over (partition by level, lang, source, rate) as total
    from grouped
), quartiles as (
    select level, lang, source, rate, max(total) as n,
        min(cell) filter (upto * 4 > total - 1) as low, min(cell) filter (upto * 4 > (total - 1) * 2) as mid,
        min(cell) filter (upto * 4 > (total - 1) * 3) as high
    from ranked group by all
), allowed as (
    select * from (values ('symbols', 1000), ('dup_lines', 1000), ('repeats', 1800), ('word_length', 30000))
        as v(rate, allowance)
), picked as (
    select o.lang, o.source, o.rate,
        case when o.n >= 100 then o.low when l.n >= 100 then l.low else a.low end as low,
        o.mid, o.n >= 100 as alone,
        case when o.n >= 100 then o.high when l.n >= 100 then l.high else a.high end as high
    from quartiles o
    join quartiles l on l.level = 'language' and l.lang is not distinct from o.lang and l.rate = o.rate
    join quartiles a on a.level = 'all' and a.rate = o.rate
    where o.level = 'own'
), bounds as (
    select lang, source, rate,
        case when alone then mid - (high - mid) * 12 else low - (high - low) * 6 end - allowance as least,
        case when alone then mid + (mid - low) * 12 else high + (high - low) * 6 end + allowance as most
    from picked join allowed using (rate)
), verdicts as (
    select r, bool_and(v <= most and (rates.rate <> 'word_length' or v >= least)) as fine
    from rates join bounds on rates.lang is not distinct from bounds.lang
        and rates.source is not distinct from bounds.source and rates.rate = bounds.rate
    group by r
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    coalesce(not base_failed and fine, false) as kept
from judged left join verdicts using (r)
"""

ORACLES = {
    "op1_warc": OP1,
    "op2_decontaminate": OP2,
    "op5_chat": OP5,
    "op7_minhash": OP7,
    "op9_quality": OP9,
}
