"""The registered queries restated as plain SQL over the given tables, as an independent check."""

from __future__ import annotations

from newsloom.operators.tagging import REJECTED_CLASSES, STOPWORDS

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = "[a-zäöåA-ZÄÖÅ-]{3,}"
BASE = "https://example.org/ap"
NOW = "timestamp '2024-02-01 00:00:00'"
SEARCH = "('the', 'les', 'der')"
ISO = "'%Y-%m-%dT%H:%M:%SZ'"
K = "cast(json_extract_string(props, '$.k') as bigint)"


def _at(minutes: str) -> str:
    return f"timestamp '2024-01-01 00:00:00' + to_minutes(cast({minutes} as bigint))"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _unescape(text: str) -> str:
    for entity, character in [
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&nbsp;", "\u00a0"),
        ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"),
    ]:
        text = f"replace({text}, '{entity}', '{character}')"
    return text


def _clean(text: str, collapse: bool = True) -> str:
    bare = f"regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g')"
    if not collapse:
        return _unescape(bare)
    return _strip(_unescape(f"regexp_replace({bare}, '{SPACE}+', ' ', 'g')"))


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


CTES = {
    "activities": f"""
select 'act/' || event_id id,
  case event_type when 'click' then 'Like' when 'error' then 'Dislike' when 'signup' then 'Create'
    when 'view' then 'Update' else 'Delete' end as type,
  'users/' || user_id actor,
  case event_type when 'signup' then 'comments/' || event_id
    when 'purchase' then 'comments/' || (event_id - 1 - event_id % 7)
    else 'doc/' || ((user_id * 1009 + {K} * 31 + event_id) % (select max(doc_id) + 1 from documents)) end object_id,
  case when event_type = 'signup' then 'doc/' || ((user_id * 1009 + {K} * 31 + event_id) % (select max(doc_id) + 1 from documents)) end thread_root,
  ts published, ts + interval 2 seconds received_at
from events""",
    "likes": """
select actor, object_id, id activity_id, type reaction_type, published from (
  select *, row_number() over (partition by actor, object_id order by published desc, id desc) r
  from activities where type in ('Like', 'Dislike')) where r = 1""",
    "tokens": f"""
select id, generate_subscripts(l, 1) pos, unnest(l) t
from (select 'doc/' || doc_id id, regexp_extract_all(text, '{WORD}') l from documents)""",
    "object_tags": """
select id, tag, n, rk from (
  select *, row_number() over (partition by id order by n desc, p) rk from (
    select id, lower(trim(t, '-')) tag, count(*) n, min(pos) p from tokens group by 1, 2)
  where length(tag) >= 3) where rk <= 16""",
    "objects": f"""
select doc_id, 'doc/' || doc_id id, source, {_at("doc_id*37%43200")} published,
  case when doc_id % 5 <> 0 then {_at("doc_id*37%43200 + doc_id%1000")} end updated,
  doc_id % 4 <> 0 tags_enriched, doc_id % 3 = 0 og_enriched, doc_id % 7 like_count, doc_id % 3 dislike_count,
  doc_id % 17 = 0 deleted, doc_id % 29 <> 0 has_doc,
  case when doc_id % 29 <> 0 then substring(text, 1, 60) end as name, case when doc_id % 29 <> 0 then text end summary,
  case when doc_id % 29 <> 0 then 'https://' || source || '.example/doc/' || doc_id end url
from documents""",
    "notes": f"""
select 'conv/' || conv_id || '/' || turn id, case when turn = 0 then 'forum' else 'user' end source,
  {_at("conv_id*11%20000 + turn")} published, {_at("conv_id*11%20000 + turn")} updated,
  (conv_id + turn) % 13 = 0 deleted,
  case when turn = 0 then 'Article' else 'Note' end kind,
  case when turn = 0 then text end as name, case when turn > 0 then text end as content,
  case when turn > 0 then 'users/' || ((conv_id + turn) % (select max(user_id) + 1 from events)) end as owner,
  case when turn > 0 then 'conv/' || conv_id || '/' || (turn - 1) end in_reply_to,
  case when turn > 1 then 'conv/' || conv_id || '/0' end thread_root
from conversations""",
    "board": """
select id, source, published, updated, deleted, case when has_doc then 'Article' end kind, name, summary,
  null::varchar as content, null::varchar as owner, null::varchar in_reply_to, null::varchar thread_root, like_count from objects
union all
select id, source, published, updated, deleted, kind, name, null, content, owner, in_reply_to, thread_root, 0 from notes""",
    "facts": """
select b.id, b.kind, b.owner, b.in_reply_to, b.thread_root, b.deleted, g.kind parent_kind
from board b left join board g on b.in_reply_to = g.id""",
    "edits": f"""
select case when doc_id % 3 = 0 then 'doc/' || (doc_id + 1000000000) else 'doc/' || doc_id end id, source || '-feed' source,
  {_at("doc_id*37%43200 + 5")} published, case when doc_id % 31 <> 0 then {_at("doc_id*37%43200 + 500")} end updated,
  'edit ' || doc_id as name
from documents""",
    "note_versions": f"""
select 'conv/' || conv_id || '/' || turn || case when turn % 2 = 0 then '' else '/new' end id,
  {_at("conv_id%1000")} published, 'edit ' || text as content
from conversations""",
    "feed": f"""
select *, doc_id % 13 <> 0 has_link, doc_id % 11 <> 0 has_date, case when doc_id % 13 <> 0 then 'https://news.example/' || doc_id else '' end link,
  {_clean("plain || ' &amp; more'")} title,
  {_clean("'<p>' || plain || '</p>  <b>x</b>'")} summary,
  {_at("doc_id*37%43200")} - case when doc_id % 2 = 0 then interval 2 hours else interval 0 hours end published,
  case when doc_id % 3 = 0 then 'https://img.example/t' || doc_id || '.jpg'
    when doc_id % 3 = 1 then 'https://img.example/e' || doc_id || '.jpg'
    when page % 2 = 0 then 'https://img.example/channel.png' end image_url
from (select doc_id, case when doc_id % 37 = 0 then -1 - doc_id else doc_id // 40 end page, case doc_id % 4 when 0 then 'hs' when 1 then 'is' else source end source,
  coalesce(text, '') plain from documents)""",
    "last_items": """
select source, page, max(doc_id) doc_id, count(*) n from feed group by 1, 2 having bool_or(doc_id % 3 <= 1)""",
    "publishers": """
select * from (values ('hs', 'Helsingin Sanomat', 'https://www.hs.fi'), ('iltalehti', 'Iltalehti', 'https://www.iltalehti.fi'),
  ('is', 'Ilta-Sanomat', 'https://www.is.fi'), ('kauppalehti', 'Kauppalehti', 'https://www.kauppalehti.fi'),
  ('mtv', 'MTV Uutiset', 'https://www.mtvuutiset.fi'), ('valtioneuvosto', 'Valtioneuvosto', 'https://valtioneuvosto.fi')) p(source, name, url)""",
    "og": """
select doc_id, source, 'https://' || source || '.example/doc/' || doc_id page_url,
  case when doc_id % 4 <> 0 and plain <> '' then plain when doc_id % 4 <> 0 then 'First' else 'Page ' || doc_id || ' & more' end title,
  case when doc_id % 4 >= 1 then 'a > b ' || doc_id else 'plain ' || doc_id end description,
  case when doc_id % 2 = 0 then 'https://img.example/og' || doc_id || '.png' end image,
  'https://' || source || '.example/doc/' || doc_id url,
  case when doc_id % 3 = 0 then 'Site "X"' end site_name,
  case doc_id % 5 when 1 then '2024-01-05T10:00:00Z' when 2 then 'yesterday' end published_time,
  case when doc_id % 6 = 1 then '2024-01-06T10:00:00+02:00' end modified_time
from (select doc_id, source, coalesce(text, '') plain from documents)""",
    "scraped": f"""
select doc_id, '{BASE}/objects/scraped/' || sha256(page_url) id, {_strip("title")} as name, {_strip("description")} summary, url,
  case when published_time like '2024%' then timestamp '2024-01-05 10:00:00' else {NOW} end published,
  case when modified_time is not null then timestamp '2024-01-06 08:00:00' else {NOW} end updated,
  case when published_time like '2024%' then published_time else '2024-02-01T00:00:00Z' end published_text,
  coalesce(site_name, source || '.example') author, image image_url
from og where {_strip("title")} <> ''""",
    "config": f"""
select 'rss.' || source || '.rss_url' as key, 'https://' || source || '.example/rss' as value,
  timestamp '2024-01-01 00:00:00' updated_at, 'seed' updated_by from documents group by source
union all
select 'rss.' || source || '.last_fetched_at', '2024-01-02T00:00:00Z', timestamp '2024-01-01 00:00:00', 'seed'
from documents group by source having max(doc_id) % 2 = 0""",
    "searches": f"""
select *, list_distinct(typed) tags, case when len(typed) = 0 then 'at least one tag is required'
  when n not between 1 and 500 then 'n must be between 1 and 500' end reason
from (select 'b' || item_id search_id, case when item_id % 7 = 0 then 50 else cast(item_id * 17 % 503 as integer) end n,
  case when item_id % 11 = 0 then [] else list_transform(regexp_extract_all(text, '{WORD}'), lambda w: lower(upper(w))) end typed from benchmark)""",
    # ---- requests: pieces of the payloads as columns
    "ev": f"""
select event_id e, user_id u, event_type et, {K} k, user_id * 1009 + {K} * 31 + event_id spread, ts,
  'users/' || user_id actor, event_id - 1 - event_id % 7 earlier from events""",
    "made": f"""
select e earlier, '{BASE}/objects/comments/' || sha256('Create|' || actor || '|r' || e) made_id from ev where et = 'signup'""",
    "aimed": """
select ev.*, case when e % 4 = 0 then 'doc/' || (spread % (select max(doc_id) + 1 from documents)) when e % 4 = 3 then coalesce(made_id, 'comments/none')
  else 'conv/' || (spread % (select max(conv_id) + 1 from conversations)) || '/' || case when e % 4 = 1 then k % (select max(turn) + 1 from conversations) else 0 end end target
from ev left join made using (earlier)""",
    "req": """
select 'r' || e request_id, e,
  case when e % 101 = 0 then null when e % 103 = 0 then 'Announce' when et = 'click' then 'Like' when et = 'error' then 'Dislike'
    when et = 'signup' then 'Create' when et = 'view' then 'Update' else 'Delete' end as type,
  actor, ts received_at, struct_pack(t := ts, r := 'r' || e) as moment, et in ('signup', 'view') and not (et = 'view' and e % 47 = 0 and e % 2 <> 0 and e % 3 <> 0) has_payload,
  case when et not in ('signup', 'view') and e % 97 <> 0 then target
       when et = 'view' and e % 47 <> 0 then target end target_id,
  case when et = 'signup' then case when e % 41 = 0 then 'Article' else 'Note' end end payload_type,
  case when et = 'signup' and e % 43 <> 0 then target end reply,
  case when et = 'view' and e % 2 = 0 then 'name ' || e end new_name,
  case when et = 'view' and e % 3 = 0 then 'text ' || e end new_content
from aimed""",
    "checked": """
select *, case when type = 'Create' then reply end in_reply_to,
  case when malformed is null then case when type = 'Create' then reply else target_id end end lookup_id from (
  select *, case
    when type is null or (target_id is null and not has_payload) then 'missing type or object'
    when type in ('Like', 'Dislike') and target_id is null then 'missing object id for reaction'
    when type = 'Create' and payload_type <> 'Note' then 'only notes can be created'
    when type = 'Create' and reply is null then 'inReplyTo is required'
    when type in ('Delete', 'Update') and target_id is null then 'missing object id'
    when type not in ('Like', 'Dislike', 'Create', 'Delete', 'Update') then 'activity type is not supported' end malformed
  from req)""",
    "valid": "select * from checked where malformed is null",
}
_ID = f"'{BASE}/objects/comments/' || sha256('Create|' || v.actor || '|' || v.request_id)"
_ALIVE = (
    "(k.id is not null and (k.created_at is null or k.created_at < v.moment)"
    " and not k.deleted and coalesce(k.deleted_at >= v.moment, true))"
)
_THREAD = (
    "case when k.kind = 'Note' and coalesce(k.parent_kind = 'Note', false) then 'reply thread depth limit exceeded'"
    " when k.kind is null or k.kind not in ('Article', 'Note') then 'unsupported parent object type' end"
)
_ROOT = "case when k.kind = 'Article' then k.id else coalesce(k.thread_root, k.in_reply_to) end"


def _killed(source: str) -> str:
    return f"""
select f.*, d.deleted_at from {source} f left join (
  select f.id, min(v.moment) deleted_at from {source} f join valid v on v.lookup_id = f.id
  where v.type = 'Delete' and v.actor = f.owner and not f.deleted and (f.created_at is null or f.created_at < v.moment)
  group by f.id) d on d.id = f.id"""


def _notes_on(known: str) -> str:
    return f"""
select {_ID} id, 'Note' kind, v.actor as owner, v.in_reply_to, {_ROOT} thread_root, false deleted, k.kind parent_kind, v.moment created_at
from valid v join {known} k on k.id = v.lookup_id
where v.type = 'Create' and {_ALIVE} and ({_THREAD}) is null"""


_MOMENT = "cast(null as struct(t timestamp, r varchar))"
CTES |= {
    "known0": _killed(f"(select *, {_MOMENT} created_at from facts)"),
    "notes1": _notes_on("known0"),
    "known1": _killed("notes1"),
    "notes2": _notes_on("known1"),
    "known2": _killed("notes2"),
    "known": """
select id, kind, owner, in_reply_to, thread_root, deleted, parent_kind, created_at, deleted_at from known0
union all select id, kind, owner, in_reply_to, thread_root, deleted, parent_kind, created_at, deleted_at from known1
union all select id, kind, owner, in_reply_to, thread_root, deleted, parent_kind, created_at, deleted_at from known2""",
    "attempts": f"""
select v.request_id, coalesce(lag(v.type) over (partition by v.actor, v.lookup_id order by v.received_at, v.request_id), l.reaction_type) previous
from valid v join known k on k.id = v.lookup_id left join likes l on l.actor = v.actor and l.object_id = v.lookup_id
where v.type in ('Like', 'Dislike') and {_ALIVE}""",
    "reasons": f"""
select v.*, a.previous, k.kind target_kind, {_ROOT} root, case
  when v.malformed is not null then v.malformed
  when v.type in ('Like', 'Dislike') and a.request_id is null then 'target object not found or deleted'
  when v.type in ('Like', 'Dislike') and a.previous = v.type then 'already_reacted'
  when v.type = 'Create' and not {_ALIVE} then 'parent object not found or deleted'
  when v.type = 'Create' then {_THREAD}
  when v.type = 'Delete' and not (k.id is not null and (k.created_at is null or k.created_at < v.moment)) then 'object not found'
  when v.type = 'Delete' and (k.deleted or coalesce(k.deleted_at < v.moment, false)) then 'already_deleted'
  when v.type = 'Update' and not {_ALIVE} then 'object not found or deleted'
  when v.type in ('Delete', 'Update') and coalesce(k.owner, '') <> v.actor then 'not the owner' end reason
from checked v left join known k on k.id = v.lookup_id left join attempts a on a.request_id = v.request_id""",
    "decided": f"""
select v.*, v.reason is null accepted, case
  when v.reason is null and v.type in ('Like', 'Dislike', 'Create') then 201
  when v.reason is null or v.reason in ('already_reacted', 'already_deleted') then 200
  when v.reason = 'not the owner' then 403 when v.reason like '%not found%' then 404 else 400 end status,
  case when v.reason is null and v.type = 'Create' then v.root end thread_root,
  case when v.reason is null then '{BASE}/activities/' || lower(v.type) || 's/' || sha256(v.type || '|' || v.actor || '|' || v.request_id) end activity_id,
  case when v.reason is null then case when v.type = 'Create' then {_ID} else v.target_id end end result_id
from reasons v""",
}


def _sql(body: str) -> str:
    """Prefix the CTEs a statement uses, found by name, in order of definition."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:from|join) {name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} as ({CTES[name]}\n)" for name in CTES if name in needed]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


_RANK = "relevance desc, like_count desc, updated desc nulls last, published desc nulls last, id"
_MATCHES = f"""(select o.id, o.source, o.published, o.updated, o.like_count, o.name, o.has_doc, count(*) relevance
from objects o join object_tags t on t.id = o.id where not o.deleted and t.tag in {SEARCH} group by all)"""


def _top(tokens: str, stop: list[str]) -> str:
    return f"""
select id, lemma, n, place from (
  select *, row_number() over (partition by id order by n desc, p) place from (
    select id, lemma, cast(sum(n) as bigint) n, min(p) p from ({tokens})
    where length(lemma) >= 3 and lemma not in {_list(stop)} group by id, lemma)) where place <= 16"""


_LEXICON = f"""(select distinct t token, substring(t, 1, 5) baseform,
  case when length(t) % 5 = 0 then 'sidesana' when length(t) % 5 = 1 then 'seikkasana' else 'nimisana' end as class
from (select unnest(regexp_extract_all(text, '{WORD}')) t from benchmark))"""
_PENDING = f"""(select id, {_clean("name || ' ' || summary", collapse=False)} txt, like_count from objects
where not tags_enriched and not deleted)"""
_PENDING_TOP = _top(
    f"""select id, lower(trim(t, '-')) lemma, 1 n, pos p from
(select id, generate_subscripts(l, 1) pos, unnest(l) t from (select id, regexp_extract_all(txt, '{WORD}') l from {_PENDING}))""",
    STOPWORDS,
)
_COUNTS = """(select object_id, count(*) filter (type = 'Like') like_count, count(*) filter (type = 'Dislike') dislike_count
from activities where type in ('Like', 'Dislike') and cast(published as date) >= date '2024-01-23' group by object_id)"""
_LAST = """(select coalesce(thread_root, object_id) id, max(received_at) last_activity_at from activities a
where type in ('Like', 'Dislike', 'Create')
  and not exists (select 1 from activities d where d.type = 'Delete' and d.object_id = a.object_id) group by 1)"""
_SCRAPED_TARGETS = f"""(select case when doc_id % 2 = 0 then '{BASE}/objects/scraped/' || sha256('https://' || source || '.example/doc/' || doc_id) else id end id,
  case when doc_id % 4 = 0 then 'scraped' else source end source, published, updated, og_enriched, like_count, deleted, name from objects)"""
_OG_HAVE = "(select * from og where doc_id % 19 <> 0)"
_PAGE_LINKS = "(select page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) href from pages)"
_LONGER_OG = (
    "case when length({b}) > length({a}) then {b} when {a} <> '' then {a} when {b} <> '' then {b} end"
)


def _longer(a: str, b: str) -> str:
    x, y = f"coalesce({_strip(a)}, '')", f"coalesce({_strip(b)}, '')"
    return f"nullif(case when length({y}) > length({x}) then {y} else {x} end, '')"


BODIES = {
    "outbox_top_n": f"select id, source, published, updated, like_count, relevance from {_MATCHES} order by {_RANK} limit 50",
    "outbox_total": f"select count(distinct o.id) total_items from objects o join object_tags t on t.id = o.id where not deleted and tag in {SEARCH}",
    "outbox_items_flat": f"""select id, relevance, like_count likes, strftime(updated, {ISO}) updated_text, name
from (select * from {_MATCHES} order by {_RANK} limit 50) where has_doc""",
    "outbox_many": f"""select search_id, id, published, updated, like_count, relevance, place from (
  select *, row_number() over (partition by search_id order by {_RANK}) place from (
    select s.search_id, s.n, o.id, o.published, o.updated, o.like_count, count(*) relevance
    from (select search_id, n, unnest(tags) tag from searches where reason is null) s join object_tags t on t.tag = s.tag join objects o on o.id = t.id
    where not o.deleted group by all)) where place <= n""",
    "search_urls": f"""select search_id, '{BASE}/outbox?tag=' || array_to_string(typed, '&tag=') || '&n=' || n url from searches where reason is null""",
    "search_status": """select search_id, cast(len(typed) as integer) n_tags, n, case when reason is null then 200 else 400 end status, reason
from searches""",
    "relevance_dup": f"""select id, count(*) filter (tag in {SEARCH}) + count(*) filter (tag in {SEARCH} and rk = 1) relevance from object_tags group by id""",
    "live_objects": "select id, source, like_count from objects where not deleted",
    "object_texts": f"""select id, {_clean("concat_ws(' ', nullif(name, ''), nullif(summary, ''), nullif(content, ''))", collapse=False)} as text from board""",
    "tags_top16": _top("select id, lower(trim(t, '-')) lemma, 1 n, pos p from tokens", STOPWORDS),
    "tags_lexicon": _top(
        f"""select id, lower(trim(baseform, '-')) lemma, 1 n, pos p from tokens join {_LEXICON} x on x.token = t
where class not in {_list(REJECTED_CLASSES)}""",
        STOPWORDS,
    ),
    "pending_tags": "select id from objects where not tags_enriched and not deleted",
    "pending_tags_batch": "select id from objects where not tags_enriched and not deleted order by id limit 200",
    "apply_tags": f"""select o.id, coalesce(g.tags, '') tags, o.tags_enriched or not o.deleted tags_enriched from objects o left join (
  select id, string_agg(lemma, ',' order by place) tags from ({_PENDING_TOP}) group by id) g on g.id = o.id""",
    "likes_tag": """select o.id, coalesce(string_agg(t.tag, ',' order by rk) || ',', '') || 'likes:' || like_count tags
from objects o left join object_tags t on t.id = o.id group by o.id, like_count""",
    "window_filter": "select id, published from activities where cast(published as date) >= date '2024-01-23'",
    "reaction_counts": f"select * from {_COUNTS}",
    "reaction_counts_current": """select object_id, count(*) filter (reaction_type = 'Like') like_count,
  count(*) filter (reaction_type = 'Dislike') dislike_count from likes group by object_id""",
    "apply_reaction_counts": f"""select o.id, case when c.object_id is not null and not deleted then c.like_count else o.like_count end like_count,
  case when c.object_id is not null and not deleted then c.dislike_count else o.dislike_count end dislike_count
from objects o left join {_COUNTS} c on c.object_id = o.id""",
    "streamed_counters": """select o.id, case when r.object_id is not null and not deleted then r.likes else o.like_count end like_count,
  case when r.object_id is not null and not deleted then r.dislikes else o.dislike_count end dislike_count
from objects o left join (select object_id, count(*) filter (type = 'Like' and published >= timestamp '2024-01-23 00:00:00') likes,
  count(*) filter (type = 'Dislike' and published >= timestamp '2024-01-23 00:00:00') dislikes
  from activities where type in ('Like', 'Dislike') group by object_id) r on r.object_id = o.id""",
    "streamed_reaction_state": """select actor, object_id, id activity_id, type reaction_type, received_at published from (
  select *, row_number() over (partition by actor, object_id order by received_at desc, id desc) nth from (
    select *, lag(type) over (partition by actor, object_id order by received_at, id) earlier from activities where type in ('Like', 'Dislike'))
  where earlier is distinct from type) where nth = 1""",
    "without_deleted": """select id, type, object_id from activities a
where not exists (select 1 from activities d where d.type = 'Delete' and d.object_id = a.object_id)""",
    "last_activity": f"select * from {_LAST}",
    "recency_incremental": f"select * from {_LAST}",
    "apply_last_activity": f"""select o.id, case when l.last_activity_at > o.updated then l.last_activity_at else o.updated end updated
from objects o left join {_LAST} l on l.id = o.id""",
    "refresh_counters": f"""select o.id, case when c.object_id is not null and not deleted then c.like_count else o.like_count end like_count,
  case when c.object_id is not null and not deleted then c.dislike_count else o.dislike_count end dislike_count,
  case when l.last_activity_at > o.updated then l.last_activity_at else o.updated end updated
from objects o left join {_COUNTS} c on c.object_id = o.id left join {_LAST} l on l.id = o.id""",
    "actor_object_counts": "select actor, object_id, count(*) n_activities from activities group by actor, object_id",
    "actor_stats": """select actor, count(*) filter (type = 'Like') n_likes, count(*) filter (type = 'Dislike') n_dislikes,
  count(*) filter (type = 'Create') n_comments from activities group by actor""",
    "latest_per_key_rows": """select id, type, actor, object_id, received_at from (
  select *, row_number() over (partition by actor, object_id order by received_at desc, id) r from activities) where r = 1""",
    "upsert_articles": """select coalesce(o.id, s.id) id, case when o.id is null or s.updated > o.updated then s.source else o.source end source,
  case when o.id is null or s.updated > o.updated then s.published else o.published end published,
  case when o.id is null or s.updated > o.updated then s.updated else o.updated end updated,
  coalesce(o.like_count, 0) like_count, coalesce(o.dislike_count, 0) dislike_count, coalesce(o.tags_enriched, false) tags_enriched,
  coalesce(o.og_enriched, false) og_enriched, coalesce(o.deleted, false) deleted,
  case when o.id is null or s.updated > o.updated then s.name else o.name end as name
from objects o full join edits s on s.id = o.id""",
    "upsert_scraped": f"""select coalesce(o.id, s.id) id, coalesce(o.source, 'scraped') source, coalesce(o.published, s.published) published,
  case when o.id is null or (o.source = 'scraped' and s.id is not null) then s.updated else o.updated end updated,
  case when o.id is null or (o.source = 'scraped' and s.id is not null) then true else o.og_enriched end og_enriched,
  coalesce(o.like_count, 0) like_count, coalesce(o.deleted, false) deleted,
  case when o.id is null or (o.source = 'scraped' and s.id is not null) then s.name else o.name end as name
from {_SCRAPED_TARGETS} o full join scraped s on s.id = o.id""",
    "upsert_notes": f"""select coalesce(o.id, s.id) id, coalesce(o.source, 'user') source, coalesce(o.published, s.published) published,
  case when s.id is not null then {NOW} else o.updated end updated, coalesce(o.like_count, 0) like_count,
  coalesce(o.deleted, false) deleted, case when s.id is not null then s.content else o.content end as content
from board o full join note_versions s on s.id = o.id""",
    "apply_updates": f"""select o.id, case when s.id is not null then {NOW} else o.updated end updated,
  case when s.id is not null then s.content else o.content end as content from board o left join note_versions s on s.id = o.id""",
    "soft_delete": f"""select o.id, o.deleted or d.object_id is not null deleted, case when d.object_id is not null then {NOW} else o.updated end updated
from objects o left join (select distinct object_id from activities where type = 'Dislike') d on d.object_id = o.id""",
    "lookup_objects": """select a.object_id id, o.source, o.deleted, o.like_count, o.dislike_count, o.name
from (select distinct object_id from activities) a left join objects o on o.id = a.object_id""",
    "migrate_objects": """select id, null::bigint dislike_count, og_enriched, null::varchar og_enriched_error from objects""",
    "touched_dates": """select distinct cast(published as date) published_date from (
  select published from edits union all select o.published from objects o join edits s on s.id = o.id)""",
    "null_violations": """select 0::bigint id, count(*) filter (source = 'src3-feed') source, 0::bigint published from edits""",
    "feed_items": "select source, title, link, summary, published from feed where has_link and has_date",
    "undated_items": "select source, link, title from feed where has_link and not has_date",
    "rejected_items": """select source, link, title, case when has_link then 'no readable date' else 'no link' end reason
from feed where not (has_link and has_date)""",
    "rejected_feeds": "select source, 'not readable as a feed' reason, count(*) n from last_items where n = 1 group by source",
    "recovered_items": """select source, title, link, summary, published, image_url from feed
where has_link and has_date and doc_id not in (select doc_id from last_items)""",
    "damaged_items": """select f.source, 'not readable as an item' reason, case when has_link then f.doc_id end doc_id
from feed f join last_items l on l.doc_id = f.doc_id where l.n > 1""",
    "feed_images": "select link, image_url from feed where has_link and has_date",
    "feed_pubdates": f"""select event_id, mail_date, any_date, strftime(any_date, {ISO}) printed from (
  select event_id, case when event_id % 6 <= 3 then t end mail_date, t any_date from (
    select event_id, case event_id % 6 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) - interval 90 minutes
      when 2 then date_trunc('second', ts) + interval 5 hours when 3 then date_trunc('minute', ts) + interval 2 hours
      when 4 then date_trunc('second', ts) end t from events))""",
    "feed_articles": f"""select '{BASE}/objects/articles/' || f.source || '/' || sha256(f.link) id, f.source, f.published, f.title as name, f.link url,
  strftime(f.published, {ISO}) published_text, coalesce(p.name, upper(f.source[1]) || lower(f.source[2:])) publisher, f.image_url
from feed f left join publishers p on p.source = f.source where has_link and has_date""",
    "article_ids": f"""select page_id, '{BASE}/objects/articles/hs/' || sha256(url) article_id, '{BASE}/objects/scraped/' || sha256(url) scraped_id from pages""",
    "publisher_dim": """select f.source, coalesce(p.name, upper(f.source[1]) || lower(f.source[2:])) publisher_name, coalesce(p.url, '') publisher_url
from (select distinct source from feed) f left join publishers p on p.source = f.source""",
    "page_titles": f"""select page_id, {_unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")} title, url, null::varchar description from pages""",
    "page_metadata": "select page_url, title, description, image, url, site_name, published_time, modified_time from og",
    "feed_links": """select page_url, case when doc_id % 5 = 0 then 'https://' || source || '.example/rss/' || doc_id || '.xml'
  when doc_id % 7 = 0 then 'https://' || source || '.example/news/' || doc_id || '/rss' end feed_url from og""",
    "absolute_url": f"""select page_id, case when href like '/%' then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href else href end link, count(*) n
from {_PAGE_LINKS} group by 1, 2""",
    "url_parts": """select page_id, regexp_extract(url, '://([^/?#]*)', 1) authority, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) site,
  url like 'http%://_%' is_http from pages""",
    "scraped_articles": "select id, published, updated, name, summary, url, published_text, author, image_url from scraped",
    "iso_fallback": f"""select page_url, case when published_time like '2024%' then timestamp '2024-01-05 10:00:00' else {NOW} end published from og""",
    "pending_og": "select id, url from objects where source not in ('scraped', 'user') and not og_enriched and not deleted",
    "pending_og_batch": """select id, url from objects where source not in ('scraped', 'user') and not og_enriched and not deleted
order by published desc, id limit 100""",
    "apply_og": f"""select o.id, o.og_enriched or p.id is not null og_enriched,
  case when p.id is not null and g.page_url is null then 'Fetch/Parse error: no page' end og_enriched_error,
  case when p.id is not null and g.page_url is not null then {_longer('o.name', 'g.title')} else o.name end as name,
  case when p.id is not null and g.page_url is not null then {_longer('o.summary', 'g.description')} else o.summary end summary,
  case when p.id is not null then g.image end image_url, case when has_doc then strftime(o.published, {ISO}) end published_text,
  case when p.id is not null then g.modified_time end updated_text, o.updated
from objects o left join (select id from objects where not og_enriched and not deleted and has_doc) p on p.id = o.id
left join {_OG_HAVE} g on g.page_url = o.url""",
    "og_field_merge": f"""select page_url, {_longer('page_url', 'title')} as name, {_strip('description')} summary, image image_url,
  published_time published_text, modified_time updated_text from og""",
    "longer": f"""select d.doc_id, {_longer('d.text', "case when b.doc_id % 10 <> 0 then b.text end")} as text
from documents d left join documents b on b.doc_id = d.doc_id - 1""",
    "clean_text": f"select page_id, {_clean('html')} as text from pages",
    "clean_text_tagging": f"select page_id, {_clean('html', collapse=False)} as text from pages",
    "thread_resolution": f"""select v.request_id, v.in_reply_to, case when v.reason is null then 201 when v.reason like 'parent%' then 404 else 400 end status,
  v.reason, case when v.reason is null then v.root end thread_root, case when v.reason is null then case when v.kind = 'Article' then 1 else 2 end end depth from (
  select v.request_id, v.in_reply_to, k.kind, {_ROOT} root, case when k.id is null or k.deleted then 'parent object not found or deleted' else {_THREAD} end reason
  from (select 're:' || id request_id, id in_reply_to from notes union all select 're:doc/' || (doc_id * 2), 'doc/' || (doc_id * 2) from documents) v
  left join facts k on k.id = v.in_reply_to) v""",
    "activity_dispatch": "select request_id, type, target_id, in_reply_to, malformed reason from checked",
    "activity_decisions": "select request_id, type, status, reason, thread_root from decided",
    "classify_reactions": "select request_id, status, reason, previous from decided where type in ('Like', 'Dislike')",
    "classify_creates": "select request_id, status, reason, result_id, thread_root from decided where type = 'Create'",
    "classify_deletes": "select request_id, status, reason, target_id from decided where type = 'Delete'",
    "classify_updates": "select request_id, status, reason, target_id from decided where type = 'Update'",
    "reaction_state": """select actor, object_id, activity_id, reaction_type, published from (
  select *, row_number() over (partition by actor, object_id order by batch desc, published desc, o desc) r from (
    select actor, object_id, activity_id, reaction_type, published, 0 batch, '' o from likes
    union all select actor, target_id, activity_id, type, received_at, 1, request_id from decided where accepted and type in ('Like', 'Dislike')))
where r = 1""",
    "remove_reactions": """select actor, object_id, activity_id, reaction_type from likes l
where not exists (select 1 from activities a where a.type = 'Update' and a.actor = l.actor and a.object_id = l.object_id)""",
    "activity_rows": f"""select activity_id id, type, actor, result_id object_id,
  case when type in ('Like', 'Dislike') then coalesce(target_kind, 'Article') when type = 'Delete' then coalesce(target_kind, 'Note') else 'Note' end object_type,
  in_reply_to, thread_root, received_at, type document_type, actor document_actor,
  strftime(received_at, '%Y-%m-%dT%H:%M:%S') || case when strftime(received_at, '%f') = '000000' then '' else '.' || strftime(received_at, '%f') end || 'Z' published_text
from decided where accepted""",
    "board_after_requests": """select b.id, b.source, b.deleted or d.id is not null deleted,
  coalesce(d.moved_at, u.moved_at, b.updated) updated, coalesce(u.new_name, b.name) as name, coalesce(u.new_content, b.content) as content
from (select id, source, deleted, updated, name, content from board
  union all select result_id, 'user', false, received_at, null, 'comment ' || e from decided where accepted and type = 'Create') b
left join (select target_id id, max(received_at) moved_at, arg_max(new_name, moment) filter (new_name is not null) new_name,
  arg_max(new_content, moment) filter (new_content is not null) new_content from decided where accepted and type = 'Update' group by 1) u on u.id = b.id
left join (select target_id id, min(received_at) moved_at from decided where accepted and type = 'Delete' group by 1) d on d.id = b.id""",
    "config_put": f"""select coalesce(c.key, s.key) as key, coalesce(s.value, c.value) as value,
  case when s.key is not null then {NOW} else c.updated_at end updated_at, case when s.key is not null then 'feeds' else c.updated_by end updated_by
from config c full join (select 'rss.' || source || '.last_fetched_at' as key, 'v' || max(doc_id) as value from documents group by source) s on s.key = c.key""",
    "config_get": """select k.key, coalesce(c.value, 'never') as value
from (select distinct 'rss.' || source || '.last_fetched_at' as key from documents) k left join config c on c.key = k.key""",
    "new_since": f"""select o.id, o.source, o.published from objects o left join config c on c.key = 'rss.' || o.source || '.last_fetched_at'
where o.published > case when c.key is not null then timestamp '2024-01-02 00:00:00' else timestamp '2024-01-03 00:00:00' end""",
    "resolved_feeds": """select name, feed_url from (
  select source || '.example/doc/' || doc_id as name, coalesce(c.value, case when doc_id % 5 = 0 then 'https://' || source || '.example/rss/' || doc_id || '.xml'
    when doc_id % 7 = 0 then 'https://' || source || '.example/news/' || doc_id || '/rss' end) feed_url
  from og left join config c on c.key = 'rss.' || source || '.example/doc/' || doc_id || '.rss_url') where feed_url is not null""",
    "validate_documents": """select id, kind, case when kind is null then 'no document' else 'missing keys' end problem,
  case when kind = 'Article' then '@context,url,published' when kind = 'Note' then '@context,published' end missing
from (select id, kind from board where id like 'conv/%' or kind is null)""",
    "anonymised": f"""select id, type, case when actor in (select actor from activities where type = 'Delete')
  then '{BASE}/users/' || sha256('pepper' || actor) else actor end actor from activities""",
    "without_actor_data": """select id, type, actor, object_id from activities
where actor not in (select actor from activities where type = 'Delete' and object_id like '%7')""",
    "state_from_log": """select object_id, arg_max(type, row(received_at, id)) last_type, max(received_at) last_at, bool_or(type = 'Delete') deleted,
  arg_min(actor, row(received_at, id)) filter (type = 'Create') creator from activities group by object_id""",
    "placeholders": """select id, deleted, case when deleted and kind = 'Note' and id in (select in_reply_to from board where in_reply_to is not null)
  then '[kommentti poistettu]' else content end as content from board""",
    "tag_edits": """select t.id, array_to_string(list_concat(
    list_filter(t.tags, lambda x: not list_contains(coalesce(e.removed, []), x)),
    list_filter(coalesce(e.added, []), lambda x: not list_contains(t.tags, x))), ',') tags
from (select id, list_concat(['topic2'], list(tag order by rk)) tags from object_tags group by id) t left join (
  select object_id id, list_sort(list(tag) filter (type = 'Like')) added, list(tag) filter (type = 'Dislike') removed from (
    select object_id, tag, arg_max(type, row(received_at, id)) type from (
      select *, 'topic' || ((length(id) + length(actor)) % 5) tag from activities where type in ('Like', 'Dislike')) group by 1, 2) group by 1) e
on e.id = t.id""",
    "decision_articles": f"""select '{BASE}/objects/decisions/helsinki/HEL-' || conv_id || '-' || turn id, 'ahjo' source, {_at("conv_id*7")} published,
  {_at("conv_id*7")} updated, text as name, upper(role) summary, role author from conversations where turn > 0""",
    "catalogue_documents": f"""select '{BASE}/objects/hri/datasets/' || doc_id id, 'hri' source, {_at("doc_id*37%43200")} published, 'sv ' || source name_sv,
  text summary_fi from documents""",
    "dated_pending": f"""select link, case when doc_id % 5 = 1 then timestamp '2024-01-05 10:00:00' end published from feed
where has_link and not has_date and (doc_id % 5 = 1 or {_at("doc_id*60%43200")} >= timestamp '2024-01-05 00:00:00')""",
    "allowed_pages": "select page_id, url page_url from pages where regexp_extract(url, '://([^/?#]*)', 1) like '%.org'",
}

BODIES["atom_dates"] = "select source, link, published, published updated from feed where has_link and has_date"
BODIES["feed_list"] = """select source as name, 'https://' || source || '.example/rss' url, kind = 3 autodiscover, count(*) n
from (select lang, source, max(doc_id) % 4 kind from documents group by 1, 2) where kind in (0, 3) group by all"""
BODIES["outbox_collection"] = f"""select (select count(distinct o.id) from objects o join object_tags t on t.id = o.id where not deleted and tag in {SEARCH}) total_items,
  cast(row_number() over (order by {_RANK}) - 1 as integer) place, id, like_count likes, strftime(updated, {ISO}) updated_text
from (select * from {_MATCHES} order by {_RANK} limit 50) where has_doc"""
BODIES["unreadable_documents"] = """select o.id, o.og_enriched or p.id is not null og_enriched,
  case when p.id is not null and doc_id % 19 = 0 then 'Fetch/Parse error: no page' end og_enriched_error
from objects o left join (select id from objects where not og_enriched and not deleted and has_doc and doc_id % 7 <> 0) p on p.id = o.id"""
BODIES["appended_log"] = "select id, type, actor, object_id, cast(published as date) published_date from activities"
BODIES["streamed_articles"] = BODIES["upsert_articles"]
BODIES["state_from_snapshot"] = BODIES["state_from_log"]
BODIES["anonymised_documents"] = f"""select id, case when even then '{BASE}/users/' || sha256('pepper' || author) else author end author,
  content, in_reply_to from (select id, case when kind = 'Note' then owner else '{{"type":"Organization","name":"' || role || '"}}' end author,
  kind = 'Note' and try_cast(split_part(owner, '/', 2) as bigint) % 2 = 0 even, content, in_reply_to
  from (select notes.*, role from notes join conversations on notes.id = 'conv/' || conv_id || '/' || turn))"""
BODIES["expired_pending"] = f"""select link, 'no date for 7 days' reason from feed
where has_link and not has_date and doc_id % 5 <> 1 and {_at("doc_id*60%43200")} < timestamp '2024-01-05 00:00:00'"""
BODIES["outbox_postings"] = BODIES["outbox_many"]
BODIES["refresh_pipeline"] = f"""select o.id, o.source,
  case when not og_enriched and not deleted and has_doc then {_longer('o.name', 'g.title')} else o.name end as name,
  o.og_enriched or (not deleted and has_doc) og_enriched, null::varchar og_enriched_error, o.tags_enriched or not deleted tags_enriched,
  case when c.object_id is not null and not deleted then c.like_count else o.like_count end like_count,
  case when c.object_id is not null and not deleted then c.dislike_count else o.dislike_count end dislike_count,
  case when l.last_activity_at > o.updated then l.last_activity_at else o.updated end updated
from objects o left join og g on g.page_url = o.url left join {_COUNTS} c on c.object_id = o.id left join {_LAST} l on l.id = o.id
union all
select '{BASE}/objects/articles/' || f.source || '/' || sha256(f.link), f.source, f.title, true, 'Fetch/Parse error: no page', true, 0, 0, f.published
from feed f left join config c on c.key = 'rss.' || f.source || '.last_fetched_at'
where has_link and has_date and f.published > case when c.key is not null then timestamp '2024-01-02 00:00:00' else timestamp '2024-01-31 00:00:00' end"""
BODIES["replayed_requests"] = f"""select s.actor, s.object_id,
  case when not b.deleted then case s.reaction_type when 'Like' then 'Dislike' else 'Like' end else s.reaction_type end reaction_type,
  case when not b.deleted then timestamp '2024-03-01 00:00:00' else s.published end published, 0::bigint n_twice
from ({BODIES["reaction_state"]}) s left join ({BODIES["board_after_requests"]}) b on b.id = s.object_id"""
BODIES["rewrite_touched"] = BODIES["upsert_articles"]

ORACLES = {name: _sql(body) for name, body in BODIES.items()}
