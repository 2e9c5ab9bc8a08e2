"""Each query's result as SQL over the same tables."""

from catalog.forum import HOST, POSTS_PER_PAGE, THREADS_PER_LISTING
from catalog.vocabulary import ENGLISH, GLOSSARY, LEXICON, RULES, values
from postloom.operators.rules import Rules
from postloom.sites import SITE_1, SITE_2, SITE_3

# Fixed values, written down a second time so that the SQL does not lean on what it checks.
WHITESPACE = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
AFTER_BUT = 1.5
BEFORE_BUT = 0.5
CAPS = 0.733
DAMP = {1: 1.0, 2: 0.95, 3: 0.9}
EXCLAIM = 0.292
EXCLAIM_MAX = 4
LOWER = -0.293
NEGATE = -0.74
NORMALIZE = 15
QUESTION = 0.18
QUESTION_MAX = 0.96
EDGE_MARKS = ['.', '!', '?', ',', ';', ':', '-', "'", '"', '!!', '!!!', '??', '???', '?!?', '!?!', '?!?!', '!?!?']

_BLANKS = " || ".join(f"chr({c})" for c in WHITESPACE)


def _trim(x):
    return f"trim({x}, {_BLANKS})"


def _unescaped(x):
    """The entities of the given pages as characters; some titles end before the semicolon."""
    for entity, char in (
        ("&quot;?", "'\"'"), ("&copy;?", "chr(169)"), ("&middot;?", "chr(183)"), ("&amp;?", "'&'"),
    ):
        x = f"regexp_replace({x}, '{entity}', {char}, 'g')"
    return x


def _lines(x, separator="chr(10)"):
    """Stripped, non-empty lines of x, joined."""
    return (
        f"array_to_string([{_trim('t')} for t in string_split({x}, chr(10)) "
        f"if {_trim('t')} <> ''], {separator})"
    )


def _article(separator):
    parts = "string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>')"
    part = _trim(_unescaped("t"))
    return f"array_to_string([{part} for t in {parts} if {part} <> ''], {separator})"


_LINKS = f"""
link as (
  select page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as hrefs,
    regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as texts
  from pages),
one as (select *, unnest(range(1, len(hrefs) + 1)) as k from link),
links as (
  select page_id, url, k::integer as pos, {_unescaped('hrefs[k]')} as href,
    {_trim(_unescaped('texts[k]'))} as text
  from one)"""

_POSTS = f"""
  select (turn + 1)::integer as post_index, 'Thread ' || conv_id as thread_title,
    role as post_date, text as post_content, '{HOST}' as source_url
  from conversations"""

# Threads as each site's listing and pages show them.
_THREAD = f"""
thread as (
  select conv_id, max(turn) as last, conv_id // {THREADS_PER_LISTING} as block,
    '{HOST}/list?b=' || (conv_id // {THREADS_PER_LISTING}) as listing_url,
    (row_number() over (partition by conv_id // {THREADS_PER_LISTING} order by conv_id))::integer
      as thread_pos
  from conversations group by conv_id)"""

_SITE_1 = f"""{_THREAD},
linked as (
  select *, case when last = 2 then null
    else '{HOST}/t' || conv_id || case when last = 4 then 'gone' else '' end end
    as thread_url
  from thread),
outcome as (
  select conv_id, thread_url,
    case when last = 4 then 'no page' when last = 3 then 'no title' else 'kept' end
      as outcome
  from linked where thread_url is not null),
post as (
  select o.thread_url, c.role,
    (row_number() over (partition by c.conv_id order by c.turn))::integer as post_index,
    'Thread ' || c.conv_id as thread_title, c.role || '#' || c.turn as post_date,
    {_lines('c.text')} as post_content, '{SITE_1.source_url}' as source_url
  from outcome o join conversations c using (conv_id) where o.outcome = 'kept')"""

_SITE_2 = f"""{_THREAD},
post as (
  select '{HOST}/t' || conv_id as thread_url,
    '{HOST}/t' || conv_id || 'p' || (last // {POSTS_PER_PAGE} + 1) as last_page_url,
    (row_number() over (partition by conv_id order by turn))::integer as post_index,
    'Thread ' || conv_id as thread_title, role || '#' || turn as post_date,
    {_lines('text')} as post_content, '{SITE_2.source_url}' as source_url
  from thread join conversations using (conv_id)
  where turn // {POSTS_PER_PAGE} = last // {POSTS_PER_PAGE})"""

_SITE_3 = f"""
item as (
  select conv_id, text, row_number() over (partition by conv_id order by turn) as n
  from conversations),
dated as (
  select conv_id, role || ' #' || turn as post_date,
    row_number() over (partition by conv_id order by turn) as n
  from conversations where role <> 'system'),
post as (
  select '{HOST}/t' || conv_id as thread_url, n::integer as post_index,
    'Thread ' || conv_id as thread_title, post_date, {_lines('text')} as post_content,
    '{SITE_3.source_url}' as source_url
  from item join dated using (conv_id, n))"""

_CANONICAL = "post_index, thread_title, post_date, post_content, source_url"

_MEMORY = """
memory as (
  select text as source_text, min('[' || lang || '] ' || text) as target_text
  from documents where lang in ({langs}) group by text)"""


def _tokens(source, key, text, prefix=""):
    """One row per white-space token: key, position from 0, token."""
    return f"""
{prefix}part as (
  select {key}, string_split_regex({_trim(text)}, '{WS}+') as parts from {source}
  where {_trim(text)} <> ''),
{prefix}token as (
  select {key}, unnest(parts) as w, unnest(range(0, len(parts))) as i from {prefix}part)"""


def _listed(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) or "null"


def _compound(source, key, text, prefix="", rules=RULES):
    """CTEs ending in `scored`: key and score of each non-blank text."""
    marks = "|".join(
        "".join("\\" + c if c in "?.!-" else c for c in m).replace("'", "''")
        for m in sorted(EDGE_MARKS, key=len, reverse=True)
    )
    word = "[^[:punct:]]{2,}"
    edge = f"^(?:(?:{marks})({word})|({word})(?:{marks}))$"
    up = lambda x: f"(upper({x}) = {x} and lower({x}) <> {x})"
    so = lambda x: f"coalesce({x} in ('so', 'this'), false)"
    never = lambda x: f"coalesce({x} = 'never', false)"
    booster = "case " + " ".join(
        f"when {{0}} = '{k}' then {v}" for k, v in rules.boosters.items()
    ) + " end"
    idiom = "case {0} " + " ".join(
        f"when '{k}' then {v}" for k, v in rules.idioms.items()
    ) + " end"

    steps, last = [], "s0"
    for k in (1, 2, 3):
        factor = f"when l{k} in ({_listed(rules.negations)}) or l{k} like '%n''t%' then {NEGATE}"
        if k == 2:
            factor = f"when {never('w2')} and {so('w1')} then 1.5 " + factor
        if k == 3:
            factor = f"when ({never('w3')} and {so('w2')}) or {so('w1')} then 1.25 " + factor
        boost = booster.format(f"l{k}")
        shout = f"case when {up(f'w{k}')} and caps then case when x > 0 then {CAPS} else -{CAPS} end else 0 end"
        signed = f"coalesce((({boost}) * (case when x < 0 then -1 else 1 end) + {shout}) * {DAMP[k]}, 0)"
        steps.append(
            f"s{k} as (select * replace (case when p >= {k} and v{k} is null "
            f"then (x + {signed})::double * (case {factor} else 1 end)::double else x end as x) "
            f"from {last})"
        )
        last = f"s{k}"
    phrases = [
        "w || ' ' || n1 || ' ' || n2", "w || ' ' || n1", "w1 || ' ' || w",
        "w2 || ' ' || w1 || ' ' || w", "w2 || ' ' || w1", "w3 || ' ' || w2 || ' ' || w1",
        "w3 || ' ' || w2",
    ]
    pairs = _listed(k for k in rules.boosters if " " in k)
    soft = f"(w3 || ' ' || w2) in ({pairs}) or (w2 || ' ' || w1) in ({pairs})"
    found = ", ".join(f"({idiom.format(f'({p})')})" for p in phrases)
    steps.append(
        f"s4 as (select * replace (case when p >= 3 and v3 is null then coalesce({found}, x)::double "
        f"+ case when {soft} then {LOWER} else 0 end else x end as x) from s3)"
    )
    steps.append(
        f"s5 as (select * replace (case when p >= 1 and v1 is null and l1 = 'least' "
        f"and (l2 is null or l2 not in ('at', 'very')) then x * {NEGATE} else x end as x) from s4)"
    )
    lags = ", ".join(
        f"lag({c}, {k}) over o as {c}{k}" for k in (1, 2, 3) for c in ("w", "l", "v")
    )
    return f"""{_tokens(source, key, text, prefix)},
kept as (select {key}, i, w from {prefix}token where length(w) > 1),
word as (
  select {key}, row_number() over (partition by {key} order by i) - 1 as p,
    regexp_replace(w, '{edge}', '\\1\\2') as w
  from kept),
valued as (
  select word.*, lower(w) as l, x.v
  from word left join (values {values(LEXICON, True)}) x(tok, v) on x.tok = lower(word.w)),
near as (
  select *, {lags}, lead(w, 1) over o as n1, lead(w, 2) over o as n2, lead(l, 1) over o as nl
  from valued window o as (partition by {key} order by p)),
doc as (
  select {key}, min(p) filter (where l = '{rules.contrast}') as but,
    count(*) as n, count(*) filter (where {up('w')}) as shouted
  from valued group by {key}),
hit as (
  select near.*, but, shouted > 0 and shouted < n as caps from near join doc using ({key})
  where v is not null and l not in ({_listed(rules.boosters)})),
s0 as (
  select *, v + case when {up('w')} and caps then case when v > 0 then {CAPS} else -{CAPS} end
    else 0 end as x
  from hit
  qualify row_number() over (partition by {key}, w order by p) = 1),
{", ".join(steps)},
summed as (
  select h.{key}, sum(case when s5.l = 'kind' and coalesce(s5.nl = 'of', false) then 0 else s5.x end
    * case when h.but is null or h.p = h.but then 1 when h.p < h.but then {BEFORE_BUT}
      else {AFTER_BUT} end) as total
  from hit h join s5 on s5.{key} = h.{key} and s5.w = h.w group by h.{key}),
marks as (
  select {key}, length({text}) - length(replace({text}, '!', '')) as e,
    length({text}) - length(replace({text}, '?', '')) as q
  from {source} where {_trim(text)} <> ''),
loud as (
  select {key}, coalesce(total, 0) + sign(coalesce(total, 0)) * (least(e, {EXCLAIM_MAX}) * {EXCLAIM}
    + case when q < 2 then 0 when q < 4 then q * {QUESTION} else {QUESTION_MAX} end) as s
  from marks left join summed using ({key})),
scored as (select {key}, round(s / sqrt(s * s + {NORMALIZE}), 4)::double as sentiment_score from loud)"""


def _glossary(source, key, text):
    """CTEs ending in `english`: key and token-wise translation of each non-blank text."""
    return f"""{_tokens(source, key, text)},
english as (
  select {key}, string_agg(coalesce(g.target, w), ' ' order by i) as translated_post_content
  from token left join (values {values(GLOSSARY)}) g(tok, target) on g.tok = lower(w)
  group by {key})"""


def _english(text):
    for word, other in ENGLISH.items():
        text = f"replace({text}, '{word}', '" + other.replace("'", "''") + "')"
    return text


_DOC_COMPOUND = (
    f"with {_compound('documents', 'doc_id', 'text')} "
    "select d.doc_id, sentiment_score from documents d left join scored using (doc_id)"
)
_DOC_GLOSSARY = (
    f"with {_glossary('documents', 'doc_id', 'text')} "
    "select doc_id, coalesce(translated_post_content, '') as translated_post_content "
    "from documents left join english using (doc_id)"
)
_TRANSLATED = f"""with {_MEMORY.format(langs="'fr', 'de'")}
select doc_id, coalesce(target_text, text) as translated_post_content,
  case when target_text is not null then 'memory' else 'original' end as via
from documents left join memory on text = source_text"""
_LEXICON_JOIN = f"""with {_tokens('documents', 'doc_id', 'text')}
select doc_id, i::integer as pos, lower(w) as token, v as valence
from token join (values {values(LEXICON, True)}) x(tok, v) on tok = lower(w)"""
_LAST_PAGE = f"""select conv_id, turn // {POSTS_PER_PAGE} as page_no, turn from conversations
qualify turn // {POSTS_PER_PAGE} = max(turn // {POSTS_PER_PAGE}) over (partition by conv_id)"""


def _margin(logits, pos, neg):
    total = " + ".join(f"exp({x})" for x in logits)
    return f"(exp({logits[pos]}) - exp({logits[neg]})) / ({total})"


def _dims(n, times=1):
    return [f"(embedding[{i + 1}]::double * {times})" for i in range(n)]


def _weighted():
    """Three sums over all 64 values, as 32-bit floats."""
    return [
        "cast(" + " + ".join(
            f"embedding[{i + 1}]::double * {((i * 7 + c * 3) % 11 - 5) / 4}" for i in range(64)
        ) + " as float)::double"
        for c in range(3)
    ]


_TURN_SCORES = f"""with turns as (
  select conv_id * 1000 + turn as id, * from conversations),
{_compound('turns', 'id', 'text')}
select conv_id, turn, role, sentiment_score from turns left join scored using (id)"""

_ALL_SITES = f"""
all_posts as (
  select * from (with {_SITE_1} select {_CANONICAL} from post where role <> 'system')
  union all select * from (with {_SITE_2} select {_CANONICAL} from post)
  union all select * from (with {_SITE_3} select {_CANONICAL} from post))"""

# Translation and score of a `turns` table of (id, text or post_content).
_GLOSSED = f"""{_glossary('turns', 'id', 'post_content')},
english_turns as materialized (
  select turns.*, coalesce(translated_post_content, '') as translated_post_content
  from turns left join english using (id))"""
_SCORED = _compound("english_turns", "id", "translated_post_content", prefix="en_")

ORACLES = {
    "page_scan": "select page_id, url, length(html)::integer as n_chars from pages",
    "csv_roundtrip": _POSTS,
    "csv_short_rows": f"""select *, null::varchar as translated_post_content,
  null::double as sentiment_score from ({_POSTS})""",
    "csv_reordered": _POSTS,
    "csv_rejects": """select case when role = 'system' then 'bad post_index' else role end as reason,
  count(*) as rows from conversations group by 1""",
    "na_tokens": f"""select * replace (case post_date when 'system' then null
  when 'assistant' then 'none' else thread_title end as thread_title) from ({_POSTS})""",
    "strip_text": f"select doc_id, {_trim('text')} as stripped from documents",
    "blank_guard": """select lang, count(*) filter (where lang in ('de', 'es')) as blank,
  count(*) as docs from documents group by lang""",
    "canonical_to_legacy": f"""select thread_title, post_index, post_date, post_content
  from ({_POSTS})""",
    "legacy_to_canonical": _POSTS,
    "snapshot_export": f"select *, '20240918_111512' as stamp from ({_POSTS})",
    "replace_table": f"select *, length(post_content)::integer as n_chars from ({_POSTS})",
    "append_source_tables": """select lang as source, lang,
  count(*) * case when lang = 'en' then 2 else 1 end as rows from documents group by lang""",
    "append_isolated_sources": """select lang as source, count(*) as rows, 'gone' as failed
  from documents where lang in ('fr', 'en', 'de', 'es') group by lang""",
    "page_outline": """select page_id, len(regexp_extract_all(html, '<p>'))::integer as n_p,
  len(regexp_extract_all(html, '<a '))::integer as n_a,
  len(regexp_extract_all(html, '<br>'))::integer as n_br from pages""",
    "page_links": f"with {_LINKS} select page_id, pos, href, text from links",
    "link_by_href_prefix": f"""with {_LINKS}
select page_id, (row_number() over (partition by page_id order by pos))::integer as pos, href
from links where starts_with(href, '/th')""",
    "links_by_id_prefix": f"""with {_THREAD}
select listing_url, thread_pos as pos, '/t' || conv_id as href, 'Thread ' || conv_id as text_inline
from thread""",
    "elements_by_tag_and_class": f"""with ad as (
  select page_id, regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1) as ads from pages),
one as (select page_id, ads, unnest(range(1, len(ads) + 1)) as k from ad)
select page_id, k::integer as pos, {_trim(_unescaped('ads[k]'))} as text_joined from one""",
    "elements_by_class": f"""select '{HOST}/t' || conv_id || case when turn // {POSTS_PER_PAGE} = 0
  then '' else 'p' || (turn // {POSTS_PER_PAGE} + 1) end as url, count(*) as items
from conversations group by 1""",
    "elements_by_class_contains": f"""select '{HOST}/t' || conv_id ||
  case when turn // {POSTS_PER_PAGE} = 0 then '' else 'p' || (turn // {POSTS_PER_PAGE} + 1) end
  as url, 2 * count(*) as items
from conversations group by 1""",
    "first_title": f"""select page_id,
  {_trim(_unescaped("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} as title from pages""",
    "scoped_first_child": f"""with {_LINKS}
select page_id, pos, href, text as text_joined from links""",
    "cell_links": f"""with {_THREAD}
select listing_url as url, 'https://www.flashback.org/t' || conv_id as thread_url from thread""",
    "absolute_urls": f"""with {_LINKS}
select page_id, pos, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href as address from links""",
    "relative_addresses": r"""with base as (
  select page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) as root,
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as path,
    regexp_replace(url, '#.*$', '') as page
  from pages),
foldered as (
  select *, coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') as folder from base),
above as (
  select *, case when folder = '/' then '/' else regexp_replace(folder, '[^/]*/$', '') end as parent
  from foldered)
select page_id, pos::integer as pos, case pos
  when 0 then root || case when path = '' then '/' else path end || '?b=2'
  when 1 then root || folder || 'x'
  when 2 then root || parent || 'x'
  when 3 then root || '/x'
  when 4 then root || folder || 'b/c?d=../e'
  when 5 then root || case when length(folder) - length(replace(folder, '/', '')) <= 4 then '/'
    else regexp_extract(folder, '^(.*/)[^/]*/[^/]*/[^/]*/$', 1) end
  when 6 then page || '#t'
  else regexp_extract(root, '^(https?:)', 1) || '//h.example/p' end as address
from above, (select unnest(range(0, 8)) as pos)""",
    "text_joined": f"select page_id, {_article('chr(10)')} as text_joined from pages",
    "text_fused": f"select page_id, {_article(chr(39) * 2)} as text_fused from pages",
    "zip_truncate": f"""with {_LINKS}
select page_id, pos, text as left_text from links join pages using (page_id)
where pos <= len(regexp_extract_all(html, '<p>'))""",
    "post_index": """select conv_id, turn,
  (row_number() over (partition by conv_id order by turn))::integer as post_index
from conversations""",
    "posts_canonical": _POSTS,
    "page_count_default": r"""select page_id,
  coalesce(try_cast(regexp_extract(url, '[?&]page=(\d+)', 1) as integer), 1) as pages
from pages""",
    "last_page_address": r"""select page_id, url || 'p' ||
  coalesce(try_cast(regexp_extract(url, '[?&]page=(\d+)', 1) as integer), 1) as address
from pages""",
    "last_page_only": _LAST_PAGE,
    "last_page_only_joined": _LAST_PAGE,
    "drop_empty_links": f"""with {_SITE_1}
select listing_url, thread_pos, thread_url from linked where thread_url is not null""",
    "empty_link_counts": f"""with {_SITE_1}
select listing_url, count(*) as dropped from linked where thread_url is null group by 1""",
    "thread_outcomes": f"with {_SITE_1} select thread_url, outcome from outcome",
    "unreadable_pages": f"""with {_SITE_1}
select thread_url, case when outcome = 'no page' then outcome when conv_id % 5 = 1 then 'unreadable'
  when conv_id % 5 = 2 then 'no posts' else outcome end as outcome from outcome""",
    "unreadable_listings": f"""with {_SITE_1}
select listing_url, case when block % 2 = 1 then 0 else count(*) end::integer as n_links,
  case when block % 2 = 1 then 'unreadable' else 'kept' end as outcome
from linked group by listing_url, block""",
    "recrawled_pages": f"""with {_SITE_3}, twice as (select * from post union all select * from post)
select thread_url, {_CANONICAL} from twice""",
    "recrawled_newest": f"""with {_SITE_3}
select thread_url, count(*) as posts, 'kept' as reason from post group by 1
union all
select '{HOST}/t' || conv_id, 1, 'superseded' from conversations group by conv_id""",
    "run_metrics_all": f"""with {_ALL_SITES},
texts as (
  select case when {_trim('post_content')} = '' then 'blank' when post_content like '%ß%'
    then 'original' else 'backend' end as reason, count(*) as rows
  from all_posts group by 1),
listed as (
  select count(distinct conv_id // {THREADS_PER_LISTING}) as n from conversations),
one as (with {_SITE_1} select outcome as reason, count(*) as rows from outcome group by 1),
posted as (with {_SITE_1}
  select case when role = 'system' then 'no date' else 'kept' end as reason, count(*) as rows
  from post group by 1),
two as (with {_SITE_2} select count(*) as rows from post),
three as (with {_SITE_3} select count(*) as rows from post),
threads as (select count(distinct conv_id) as n from conversations),
short as (select count(*) as n from (
  select conv_id from conversations group by 1 having max(turn) < {POSTS_PER_PAGE}))
select * from (
  select 'listing' as stage, s.source, 'kept' as reason, n as rows
  from listed, (values ('site1'), ('site2'), ('site3')) s(source)
  union all select 'thread', 'site1', reason, rows from one
  union all select 'thread', s.source, 'kept', n from threads, (values ('site2'), ('site3')) s(source)
  union all select 'page count', 'site2', 'one page or no label', n from short
  union all select 'post', 'site1', reason, rows from posted
  union all select 'post', 'site2', 'kept', rows from two
  union all select 'post', 'site3', 'kept', rows from three
  union all select 'translation', null, reason, rows from texts
  union all select 'source', 'gone', 'no such site', 1)
where rows > 0""",
    "run_metrics": f"""with {_SITE_1}
select outcome as reason, count(*) as rows from outcome group by 1""",
    "site_child_posts": f"""with {_SITE_1}
select thread_url, {_CANONICAL} from post where role <> 'system'""",
    "reject_incomplete": f"""with {_SITE_1}
select thread_url, post_index, 'no date' as reason from post where role = 'system'""",
    "site_last_page_posts": f"""with {_SITE_2}
select thread_url, last_page_url, {_CANONICAL} from post""",
    "site_zip_posts": f"with {_SITE_3} select thread_url, {_CANONICAL} from post",
    "listing_join_pages": f"""with {_SITE_3}
select thread_url, 2 * count(*) as posts from post group by 1""",
    "union_source_posts": f"with {_ALL_SITES} select * from all_posts",
    "union_listings": f"""with {_SITE_1}
select 'today' as listing, listing_url, thread_pos, thread_url from linked
union all
select 'yesterday', listing_url, thread_pos, thread_url from linked where thread_url is not null""",
    "union_schemas": f"""{_POSTS} union all
select post_index, thread_title, post_date, post_content, null from ({_POSTS})""",
    "threads_per_source": f"""with {_SITE_1}
select 'site1' as source, count(*) as threads from outcome
union all select 'site2', count(*) from thread
union all select 'site3', count(*) from thread""",
    "posts_per_thread": "select conv_id, count(*) as posts from conversations group by 1",
    "posts_per_page": f"""select '{HOST}/t' || conv_id as url, count(*)::integer as n_items,
  (count(*) filter (where role <> 'system'))::integer as n_dates,
  (count(*) filter (where role <> 'system'))::integer as paired
from conversations group by conv_id""",
    "rows_to_many_posts": """with part as (
  select conv_id, turn, string_split(text, chr(10)) as parts from conversations),
one as (select *, unnest(range(1, len(parts) + 1)) as line from part)
select conv_id, turn, line, length(parts[line]) as line_chars from one""",
    "map_column_lengths": "select doc_id, length(text) as n from documents",
    "map_column_nfd": """select doc_id, length(text)
  + len(regexp_extract_all(nfc_normalize(text), '[áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ]')) as n
from documents""",
    "enrich_by_backend": f"""select post_index, thread_title,
  case when post_content like '%ß%' then post_content else '[en] ' || post_content end
    as translated_post_content,
  case when post_content like '%ß%' then 'original' else 'backend' end as via
from ({_POSTS})""",
    "enrich_memory_then_glossary": f"""with {_MEMORY.format(langs="'fr', 'de'")},
{_glossary('documents', 'doc_id', 'text')}
select doc_id, coalesce(target_text, translated_post_content, '') as translated_post_content,
  target_text is not null as known
from documents left join memory on text = source_text left join english using (doc_id)""",
    "translate_memory": _TRANSLATED,
    "translate_memory_joined": _TRANSLATED,
    "translate_backend": f"""with {_MEMORY.format(langs="'fr', 'de'")}
select doc_id, case when target_text like '[fr]%' then target_text when text like '%ß%' then text
    else '[en] ' || text end as translated_post_content,
  case when target_text like '[fr]%' then 'memory' when text like '%ß%' then 'original'
    else 'backend' end as via
from documents left join (
  select source_text, target_text from (
    select text as source_text, min('[fr] ' || text) as target_text
    from documents where lang = 'fr' group by text)) on text = source_text""",
    "translation_dictionary": f"""with {_MEMORY.format(langs="'fr', 'de'")}
select text, count(*) as rows, any_value(coalesce(target_text, text)) as translation,
  any_value(case when target_text is not null then 'memory' else 'original' end) as via
from documents left join memory on text = source_text group by text""",
    "translate_glossary": _DOC_GLOSSARY,
    "translate_glossary_joined": _DOC_GLOSSARY,
    "lexicon_join": _LEXICON_JOIN,
    "lexicon_join_spread": _LEXICON_JOIN,
    "lexicon_join_filtered": _LEXICON_JOIN,
    "lexicon_score": f"""with {_compound('documents', 'doc_id', 'text')},
plain as (select doc_id, coalesce(sum(v), 0) as s from valued group by doc_id)
select doc_id, case when {_trim('text')} <> '' then
  round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + {NORMALIZE}), 4)::double end
  as sentiment_score
from documents left join plain using (doc_id)""",
    "compound_score": _DOC_COMPOUND,
    "compound_score_joined": _DOC_COMPOUND,
    "margin_two_classes": f"""select vec_id, round({_margin(_dims(64), 1, 0)}, 6) as margin
from embeddings""",
    "margin_three_classes": f"""select vec_id, round({_margin(_dims(64, 100), 2, 0)}, 6) as margin
from embeddings""",
    "batch_model_logits": f"""select vec_id, round({_margin(_weighted(), 2, 0)}, 4) as margin
from embeddings""",
    "model_text_score": """select conv_id, turn, case when role <> 'system' then
  round((exp((length(text)::float / 600::float)::double) - exp(1::double))
    / (exp((length(text)::float / 600::float)::double) + exp(1::double)), 4) end as sentiment_score
from conversations""",
    "scored_posts": f"""with turns as (
  select conv_id * 1000 + turn as id, conv_id, turn, text as post_content from conversations),
{_GLOSSED},
{_SCORED}
select conv_id, (turn + 1)::integer as post_index, translated_post_content, sentiment_score
from english_turns left join scored using (id)""",
    "scored_site_posts": f"""with {_ALL_SITES},
turns as materialized (select row_number() over () as id, * from all_posts),
{_GLOSSED},
{_SCORED}
select {_CANONICAL}, translated_post_content, sentiment_score
from english_turns left join scored using (id)""",
    "incremental_posts": f"with {_LINKS} select page_id, pos, href from links",
    "incremental_site_posts": f"""with shown as (
  select c.*, max(turn) over (partition by conv_id) as last,
    (row_number() over (partition by conv_id order by turn))::integer as post_index
  from conversations c)
select '{HOST}/t' || conv_id as thread_url, post_index, 'Thread ' || conv_id as thread_title,
  role || '#' || turn as post_date, {_lines('text')} as post_content,
  '{SITE_1.source_url}' as source_url
from shown where last <> 3 and role <> 'system'""",
    "incremental_site2_posts": f"""select '{HOST}/t' || conv_id || case when turn // {POSTS_PER_PAGE} = 0
    then '' else 'p' || (turn // {POSTS_PER_PAGE} + 1) end as url,
  '{HOST}/t' || conv_id as thread_url,
  (row_number() over (partition by conv_id, turn // {POSTS_PER_PAGE} order by turn))::integer as post_index,
  'Thread ' || conv_id as thread_title, role || '#' || turn as post_date,
  {_lines('text')} as post_content, '{SITE_2.source_url}' as source_url
from conversations""",
    "incremental_site3_posts": f"with {_SITE_3} select thread_url, {_CANONICAL} from post",
    "incremental_rejects": """with page as (
  select conv_id, max(turn) as last from conversations group by 1),
reasons as (
  select case when page.conv_id % 5 = 1 then 'unreadable' when page.conv_id % 5 = 2 then 'no posts'
    when last = 3 then 'no title' end as page_reason, page.conv_id, role
  from page join conversations using (conv_id))
select page_reason as reason, count(distinct conv_id) as rows from reasons
where page_reason is not null group by 1
union all
select case when role = 'system' then 'no date' end, count(*) from reasons
where page_reason is null group by 1""",
    "incremental_scores": _TURN_SCORES,
    "incremental_last_pages": f"""with shown as (
  select *, max(turn) over (partition by conv_id) // {POSTS_PER_PAGE} + 1 as last_page,
    turn // {POSTS_PER_PAGE} + 1 as page_no from conversations),
kept as (
  select *, (row_number() over (partition by conv_id order by turn))::integer as post_index
  from shown where page_no = last_page and conv_id % 7 <> 3)
select '{HOST}/t' || conv_id as thread_url, last_page::integer as last_page, null::varchar as reason,
  post_index, 'Thread ' || conv_id as thread_title, role || '#' || turn as post_date,
  {_lines('text')} as post_content, '{SITE_2.source_url}' as source_url
from kept
union all
select distinct '{HOST}/t' || conv_id, last_page::integer, 'no page', null::integer, 'Thread ' || conv_id,
  null, null, '{SITE_2.source_url}'
from shown where conv_id % 7 = 3 and last_page > 1""",
    "incremental_titles": f"""with {_SITE_3}
select thread_url, {_CANONICAL}, null::varchar as reason from post
where regexp_extract(thread_url, '/t(\\d+)$', 1)::bigint % 7 <> 3
union all
select distinct '{HOST}/t' || conv_id, null::integer, null, null, null, '{SITE_3.source_url}', 'no title'
from conversations where conv_id % 7 = 3""",
    "enrich_via": f"""with {_MEMORY.format(langs="'fr', 'de'")},
shown as (select doc_id, text, regexp_replace(text, '[ \\n]+', '  ' || chr(10) || ' ', 'g') as apart from documents),
kinds as (
  select doc_id, 'as it is' as kind, text from shown
  union all select doc_id, 'apart', apart from shown
  union all select doc_id, 'unknown', regexp_replace(apart, '([^ \\n]+)', 'x\\1', 'g') from shown),
keyed as (select kind || doc_id as id, * from kinds),
{_tokens('keyed', 'id', 'text')},
english as (
  select id, string_agg(coalesce(g.target, w), ' ' order by i) as glossed, count(g.target) as hits
  from token left join (values {values(GLOSSARY)}) g(tok, target) on g.tok = lower(w) group by id)
select doc_id, kind,
  case when {_trim('text')} = '' then '' when target_text is not null then target_text
    when hits > 0 then glossed else text end as translated_post_content,
  case when {_trim('text')} = '' then 'blank' when target_text is not null then 'memory'
    when hits > 0 then 'glossary' else 'original' end as via
from keyed left join memory on text = source_text left join english using (id)""",
    "page_counts_defaulted": f"""with thread as (
  select conv_id, max(turn) // {POSTS_PER_PAGE} + 1 as n from conversations group by 1),
taken as (select *, case when conv_id % 3 = 2 then 1 else n end as last_page from thread),
post as (select * from conversations join taken using (conv_id) where turn // {POSTS_PER_PAGE} + 1 = last_page)
select 'thread' as stage, 'site2' as source, 'kept' as reason, count(*) as rows from thread
union all select 'post', 'site2', 'kept', count(*) from post
union all select 'page count', 'site2', 'one page or no label', count(*) from taken where last_page = 1
union all select 'page count', 'site2', 'defaulted', count(*) from thread where conv_id % 3 = 2""",
    "memory_two_runs": f"""with asked as (
  select doc_id, text, {_trim('text')} = '' as blank, text like '%ß%' as refused,
    max(lang = 'fr') over (partition by text) as known, lang from documents)
select doc_id, run, case when blank then '' when refused then text else '[en] ' || text end
    as translated_post_content,
  case when blank then 'blank' when refused then 'original'
    when run = 'last' or (run = 'later' and known) then 'memory' else 'backend' end as via
from asked, (values ('first'), ('later'), ('last')) r(run)
where (run <> 'first' or lang = 'fr') and (run <> 'last' or not refused)""",
    "encoded_pages": r"""with made as (
  select page_id, page_id % 5 as kind, regexp_replace(html, '[^\x00-\x7f\xa0-\xff\x{2013}\x{20ac}]', '?', 'g') as western,
    html from pages),
full_text as (
  select page_id, kind, case kind when 0 then '<meta charset="utf-8">'
      when 2 then '<!-- charset=utf-8 --><META http-equiv=x content=''text/html; charset=Windows-1252''>'
      when 3 then '<meta name=a><meta charset=iso-8859-1>' else '' end
    || case when kind in (2, 3) then western else html end || '<p>åäö – €</p>' as html from made)
select page_id, case kind when 1 then 'utf-16le' when 2 then 'windows-1252' when 3 then 'windows-1252'
    else 'utf-8' end as encoding,
  length(html)::integer as n_chars, md5(html) as html_md5 from full_text""",
    "ordered_export": f"""select thread_title, post_index,
  row_number() over (order by thread_title, post_index) as place, true as bounded from ({_POSTS})""",
    "post_index_ties": """with numbered as (
  select role as thread, (length(text) * length(text))::integer as position,
    row_number() over (partition by role order by length(text))::integer as n from conversations)
select thread, position, min(n) as first, max(n) as last, count(*) as n from numbered group by 1, 2""",
    "csv_five_of_seven": f"""select *,
  case when post_date <> 'user' then 't ' || post_content end as translated_post_content,
  case when post_date <> 'user' then post_index / 4 end::double as sentiment_score from ({_POSTS})""",
    "blank_guard_whole": f"""select lang, kind, count(*) filter (where kind <> 'own' or text is null or {_trim('text')} = '') as blank,
  count(*) as docs from documents, (values ('own'), ('null'), ('empty'), ('blanks')) k(kind) group by 1, 2""",
    "zip_pairs": f"""with {_LINKS},
ad as (select page_id, regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1) as ads from pages)
select page_id, pos, {_trim(_unescaped('ads[pos]'))} as left_text, text as right_text
from links join ad using (page_id) where pos <= len(ads)""",
    "reject_no_body": f"""with {_SITE_1}
select thread_url, post_index, case when role = 'system' then 'no date' else 'no body' end as reason
from post where role = 'system' or regexp_extract(thread_url, '/t(\\d+)$', 1)::bigint % 3 = 1""",
    "compound_score_default": f"""with spoken as (select doc_id, {_english('text')} as text from documents),
{_compound('spoken', 'doc_id', 'text', rules=Rules())}
select d.doc_id, sentiment_score from documents d left join scored using (doc_id)""",
    "model_text_score_whole": """select conv_id, turn, kind, case when kind = 'own' and trim(text) <> '' then
  round((exp((length(text)::float / 600::float)::double) - exp(1::double))
    / (exp((length(text)::float / 600::float)::double) + exp(1::double)), 4) end as sentiment_score
from conversations, (values ('own'), ('blank')) k(kind)""",
    "wrapped_lines": """with recursive parts as (
  select conv_id, turn, [w for w in string_split(replace(text, chr(10), ' '), ' ') if w <> ''] as ws
  from conversations),
walk as (
  select conv_id, turn, ws, 1 as i, 1 as line, length(ws[1]) as used from parts where len(ws) > 0
  union all
  select conv_id, turn, ws, i + 1,
    case when used + 1 + length(ws[i + 1]) > 40 then line + 1 else line end,
    case when used + 1 + length(ws[i + 1]) > 40 then length(ws[i + 1])
      else used + 1 + length(ws[i + 1]) end
  from walk where i < len(ws))
select conv_id, turn, line::integer as line, count(*)::integer as n_words, max(used)::integer as n_chars
from walk group by 1, 2, 3""",
    "incremental_metrics": """with page as (
  select conv_id, max(turn) as last from conversations group by 1),
reasons as (
  select case when page.conv_id % 5 = 1 then 'unreadable' when page.conv_id % 5 = 2 then 'no posts'
    when last = 3 then 'no title' end as page_reason, page.conv_id, role
  from page join conversations using (conv_id)),
counted as (
  select page_reason as reason, count(distinct conv_id) as n from reasons
  where page_reason is not null group by 1
  union all
  select case when role = 'system' then 'no date' else 'kept' end, count(*) from reasons
  where page_reason is null group by 1)
select r.reason, coalesce(n, 0)::bigint as rows, 0::bigint as third, n as written
from (values ('kept'), ('unreadable'), ('no title'), ('no posts'), ('no date'), ('no body')) r(reason)
left join counted using (reason)""",
}
