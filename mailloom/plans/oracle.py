"""The queries of the catalogue as plain SQL over the same tables, for checking results."""

from __future__ import annotations

from mailloom import rules
from mailloom.operators import classify
from mailloom.plans import catalog as cat
from mailloom.sources.tables import INDEX_CATEGORIES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
EMAIL = rules.FOUND_EMAIL


def rx(e: str, pattern: str, value: str) -> str:
    return f"regexp_replace({e}, {_q(pattern)}, {_q(value)}, 'g')"


def collapse(e: str) -> str:
    return f"trim({rx(e, SPACE + '+', ' ')}, ' ')"


def strip_space(e: str) -> str:
    return rx(e, f"^{SPACE}+|{SPACE}+$", "")


def decode(e: str) -> str:
    for name, char in (("&nbsp;", chr(160)), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                       ("&copy;", "©"), ("&middot;", "·")):
        e = f"replace({e}, {_q(name)}, {_q(char)})"
    return rx(e, "&amp;?", "&")


def strip(e: str) -> str:
    hidden = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
    tags = r"</?[A-Za-z][^>]*>|<![^>]*>|<\?[^>]*>"
    return collapse(decode(rx(rx(e, hidden, ""), tags, "")))


def root(e: str) -> str:
    return f"array_to_string(string_split({e}, '.')[-2:], '.')"


def sender(e: str) -> str:
    return f"coalesce(lower(string_split({e}, '@')[2]), 'unknown')"


def host(e: str) -> str:
    return f"regexp_extract({e}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def rewrite(e: str, pattern: str, piece: str) -> str:
    """Hits of a pattern replaced by an expression of z[2], the hit."""
    p = _q(pattern)
    return (
        f"array_to_string(flatten(list_transform(list_zip(string_split_regex({e}, {p}), "
        f"regexp_extract_all({e}, {p})), lambda z: [z[1], coalesce({piece}, '')])), '')"
    )


def rewrite_steps(table: str, key: str, column: str, piece_of: dict[str, str], result: str) -> str:
    """One common table expression per rule, in rule order."""
    parts, source, current = [], table, column
    for i, rule in enumerate(rules.PII_RULES):
        if rule.entity_type not in piece_of:
            continue
        parts.append(f"s{i} as (select {key}, {rewrite(current, rule.pattern, piece_of[rule.entity_type])} as t from {source})")
        source, current = f"s{i}", "t"
    return f"with {', '.join(parts)} select {key}, {result} from {source}"


_STAR, _SHA = "repeat('*', length(z[2]))", "sha256(z[2])"
_RED = f"case when z[2] is not null then {_q(rules.REDACTED)} end"
ENTITIES = ("CREDIT_CARD", "EMAIL_ADDRESS", "PHONE_NUMBER", "SSN")


def rewrite_all(piece: str, result: str) -> str:
    return rewrite_steps("documents", "doc_id", "text", {e: piece for e in ENTITIES}, result)


def spans(table=rules.PII_RULES, source="documents", key="doc_id") -> str:
    one = []
    for rule in table:
        p = _q(rule.pattern)
        one.append(f"""
            select {key}, '{rule.entity_type}' as entity_type, '{rule.name}' as rule,
              (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint as start,
              {rule.score}::double as score, hits[i] as hit
            from (select {key}, gaps, hits, unnest(range(1, len(hits) + 1)) as i from (
              select {key}, string_split_regex(text, {p}) as gaps, regexp_extract_all(text, {p}) as hits from {source}))""")
    return (
        f"select {key}, entity_type, rule, start, start + length(hit) as stop, score, hit from ("
        + " union all ".join(one) + ")"
    )


TEXTS = """(select doc_id as email_id, 'u' || doc_id || '@' || lang || '.' || source || '.example' as from_email,
    'Message ' || doc_id as subject, null::varchar as html_content, text as text_content from documents)"""
PAGES = f"""(select page_id as email_id, 'news@' || {host('url')} as from_email, url as subject,
    html as html_content, null::varchar as text_content from pages)"""
ALL = f"(select * from {TEXTS} union all select * from {PAGES})"

HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def hrefs(e: str) -> str:
    return f"list_transform(regexp_extract_all({e}, {_q(HREF)}, 1), lambda v: {decode('trim(v, chr(34) || chr(39))')})"


def distinct_list(e: str) -> str:
    """Distinct values in order of first occurrence."""
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


def resolve(base: str, href: str) -> str:
    site = f"regexp_extract({base}, '^([A-Za-z]+://[^/?#]*)', 1)"
    return f"case when {href} like '/%' then {site} || {href} else {href} end"


NOTE = "(select page_id, url, html, 'See ' || url || ', or <' || upper(url) || '>. Again: ' || url || ') http:// end.' as note from pages)"


def note_urls(e: str) -> str:
    found = f"regexp_extract_all({e}, {_q('(?i)' + rules.TEXT_URL)})"
    return f"list_filter({found}, lambda u: {host('u')} <> '')"


def last_lines(e: str) -> str:
    lines = f"list_filter(list_transform(string_split({e}, chr(10)), lambda l: {strip_space('l')}), lambda l: l <> '')"
    return f"case when len({lines}) >= 3 then array_to_string(({lines})[-3:], chr(10)) end"


def likely(e: str, words) -> str:
    hits = " + ".join(f"contains(lower({e}), {_q(w)})::int" for w in words)
    return f"(({hits}) >= 2 or contains({e}, '@') or contains(lower({e}), 'http'))"


def footer(e: str) -> str:
    return f"nullif({strip(f'regexp_extract_all({e}, ' + _q('(?is)<footer(?:[ \t\r\n][^>]*)?>.*?</footer>') + ')[-1]')}, '')"


SIGNATURES = """(select c_custkey, 'Sold by ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' & Sons '
    || ['Inc', 'LLC', 'Ltd'][c_nationkey % 3 + 1] || '; visit ' || c_custkey || ' '
    || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || ['Street', 'Road', 'lane'][c_custkey % 3 + 1]
    || ', or call (555) 010-' || lpad((c_custkey % 10000)::varchar, 4, '0') || ' or 1.555.010.'
    || lpad((c_custkey % 10000)::varchar, 4, '0') || ', see https://' || lower(c_mktsegment) || '.example/' || c_nationkey
    as signature from customer)"""


def details(kind: str, source: str, pattern: str, key: str, column: str, value: str) -> str:
    return f"""select {key}, {kind} unnest(list_distinct(regexp_extract_all({column}, {_q(pattern)}))) as {value}
        from {source}"""


def keywords(e: str, table, default: str = rules.DEFAULT_CATEGORY) -> str:
    cases = " ".join(
        "when " + " or ".join(f"contains(lower({e}), {_q(w)})" for w in words) + f" then {_q(c)}" for c, words in table)
    return f"case {cases} else {_q(default)} end"


def company(e: str) -> str:
    label = f"string_split({e}, '.')[-2]"
    return f"coalesce(upper({label}[1]) || lower({label}[2:]), 'Unknown Company')"


_CATS = "[" + ", ".join(_q(c) for c in INDEX_CATEGORIES) + "]"
INDEX = f"""(select vec_id as id, embedding, 'm' || (vec_id % 3) || '.r' || (label % 4) || '.example' as sender_domain,
    {_CATS}[label % 5 + 1] as email_category, 'Company ' || label as business_name,
    case when label % 2 = 0 then 'industry ' || (label % 3) end as business_industry from embeddings)"""
# Each vector as one row per coordinate would be slow; lists of doubles are enough here.
PAIRS = f"""select q.id as q_id, c.id as c_id, q.sender_domain as q_domain, c.sender_domain as c_domain,
    c.email_category, c.business_name, q.embedding::double[] as a, c.embedding::double[] as b
    from {INDEX} q, {INDEX} c where q.id <> c.id"""
SQL2 = "list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
COSINE = "1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))"


def nearest(distance: str, k: int, where: str = "true") -> str:
    return f"""select * exclude (a, b) from (select *, row_number() over (partition by q_id order by distance, c_id) as rank
        from (select *, {distance} as distance from ({PAIRS})) where {where}) where rank <= {k}"""


def knn(distance: str, k: int, where: str = "true") -> str:
    return f"select q_id, c_id, round(distance, 6) as distance, rank from ({nearest(distance, k, where)})"


WEIGHT = f"""case when q_domain = c_domain then 1.0::double
    when {root('q_domain')} = {root('c_domain')} or ends_with(q_domain, '.' || c_domain)
      or ends_with(c_domain, '.' || q_domain) then 0.8::double else 0.5::double end"""
SCORED = f"""select *, similarity * domain_weight as confidence from (
    select *, 1 - distance as similarity, {WEIGHT} as domain_weight from ({nearest(COSINE, 10)}))"""
BEST = f"""select * from (select *, row_number() over (partition by q_id order by confidence desc, distance, c_id) as pos
    from ({SCORED})) where pos = 1"""

# Unrelated domains weigh 0.3 here.
BEST_RELATED = BEST.replace("else 0.5", "else 0.3")


# Candidates of earlier batches only.
BEST_EARLIER = f"""select * from (select *, row_number() over (partition by q_id order by confidence desc, distance, c_id) as pos
    from (select *, similarity * domain_weight as confidence from (select *, 1 - distance as similarity, {WEIGHT} as domain_weight
      from ({nearest(COSINE, 10, "c_id % 3 < q_id % 3")})))) where pos = 1"""
_LABELS = "[" + ", ".join(_q(c) for c in rules.CATEGORIES) + "]"
PROMPT_HEAD = classify.DEFAULT_PROMPT.format(categories=", ".join(rules.CATEGORIES)) + "\n\nMessage:\n"
_KEY = "lpad(c_custkey::varchar, 9, '0')"
_SSN = f"{_KEY}[1:3] || '-' || {_KEY}[4:5] || '-' || {_KEY}[6:9]"


def route(best: str) -> str:
    return f"""select doc_id as email_id, case when m.q_id is null then 'classifier' else 'match' end as route,
        coalesce(m.email_category, {keywords('text', cat.LOCAL_KEYWORDS)}) as category,
        coalesce(m.business_name, {company("lang || '.' || source || '.example'")}) as name,
        round(coalesce(m.confidence, 0.3), 6) as confidence
        from documents left join (select * from ({best}) where confidence > 0.3) m on q_id = doc_id"""


RAW = """(select doc_id, case when source = 'src3' then full_raw[1:length(full_raw) - 1] else full_raw end as raw from (
    select doc_id, source, case
      when lang = 'de' then json_object('from_email', 'u' || doc_id || '@' || source || '.example', 'subject', 'Message ' || doc_id, 'text_content', text)::varchar
      when lang = 'es' then json_object('from', 'u' || doc_id || '@' || source || '.example', 'subject', 'Message ' || doc_id, 'text_content', text, 'html_content', null)::varchar
      else json_object('from', 'u' || doc_id || '@' || source || '.example', 'subject', 'Message ' || doc_id, 'html_content', text)::varchar
    end as full_raw from documents))"""
CHECKED = f"""(select doc_id as email_id, raw, case when not json_valid(raw) then 'invalid JSON'
    when not list_contains(json_keys(raw), 'html_content') then 'missing required fields: html_content' end as error from {RAW})"""

RESULTS = """(select event_id as id, 'u' || user_id || '.example' as sender_domain, ts as processed_at,
    case event_type when 'view' then 'marketing' when 'click' then 'transactional' when 'error' then 'survey'
      when 'signup' then 'personal' when 'purchase' then 'customer_support' end as email_category,
    value / (value + 1) as confidence_score, value / 50 as processing_time from events)"""
REPLIES = f"""(select id, processing_time > 8 as cut, sender_domain as name, email_category as category,
    (id % 13) / 10.0::double as confidence from {RESULTS})"""

SITE = "lang || '.' || source || '.example'"
_PATHS = "[" + ", ".join(_q(p) for p in rules.PRIVACY_PATHS) + "]"
CRAWL = f"""(select doc_id, {SITE} as site, coalesce({_PATHS}[(doc_id % 12 + 1)::int], '/post/' || doc_id) as path, text from documents)"""


def dpo(e: str) -> str:
    tries = ", ".join(f"nullif(regexp_extract({e}, {_q(p)}, 1), '')" for p in cat.LOCAL_DPO.patterns())
    return f"coalesce({tries})"


CONTACTS = f"""(select site, path, arg_min(contact, doc_id) as contact from (
        select doc_id, site, path, {dpo('t')} as contact from (
          select doc_id, site, path, {strip('text')} as t from {CRAWL}) where length(t) > 0)
      where contact is not null group by all)"""


def policies(placed: str) -> str:
    """Sites with the first of their placed contacts (site, contact, url, pos)."""
    return f"""(with placed as ({placed}),
    best as (select site, arg_min(contact, spot) as dpo_email, arg_min(url, spot) as privacy_policy_url
      from (select *, struct_pack(pos := pos, url := url) as spot from placed) group by site)
    select s.site, dpo_email, privacy_policy_url, dpo_email is not null as success,
      case when dpo_email is null then 'No DPO email found in privacy policies' end as error_message
    from (select distinct {SITE} as site from documents) s left join best using (site))"""


POLICIES = policies(f"""select site, contact, 'https://' || site || path as url, list_position({_PATHS}, path) as pos
    from {CONTACTS} where list_position({_PATHS}, path) is not null""")
LINKED_POLICIES = policies(f"""select site, contact, 'https://' || site || path as url,
    coalesce(list_position({_PATHS}[:{len(cat.LINKED_PATHS)}], path), {len(cat.LINKED_PATHS) + 1}) as pos from {CONTACTS}""")

LABELS = """(select doc_id, case when toxic = 1 then 'transactional' when quality = 1 then 'survey' else 'personal' end as expected from labels)"""
PREDICTIONS = f"""(select doc_id, n_chars / (n_chars + 100)::double as confidence, p.model as model, p.predicted as predicted from (
    select doc_id, n_chars, unnest([
      {{'model': 'default', 'predicted': {keywords('text', rules.CATEGORY_KEYWORDS)}}},
      {{'model': 'local', 'predicted': {keywords('text', cat.LOCAL_KEYWORDS)}}},
      {{'model': 'short', 'predicted': {keywords('text', cat.SHORT_KEYWORDS)}}}]) as p from documents))"""
CONFUSION = f"""(select model, expected, predicted, count(*) as messages from {PREDICTIONS} join {LABELS} using (doc_id)
    group by all)"""
PROVIDERS = """(select source as provider, max(n_chars) % 4 <> 0 as success,
    case max(n_chars) % 3 when 0 then 'survey' when 1 then 'marketing' end as category,
    round(avg(n_chars) / (avg(n_chars) + 1000), 2) as confidence, max(n_chars) / 1000.0::double as processing_time
    from documents group by source)"""

ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>.*?</a\s*>"""
_VALUES_OF = (
    ("email", [r.pattern for r in rules.PII_RULES if r.entity_type == "EMAIL_ADDRESS"]),
    ("phone_number", [r.pattern for r in rules.PII_RULES if r.entity_type == "PHONE_NUMBER"]),
    ("credit_card_number", [r.pattern for r in rules.PII_RULES if r.entity_type == "CREDIT_CARD"]),
)


def _luhn(e: str) -> str:
    digit = f"({e}[length({e}) - i + 1])::int"
    return (
        f"list_sum(list_transform(range(1, length({e}) + 1), lambda i: case when i % 2 = 1 then {digit} "
        f"when {digit} > 4 then {digit} * 2 - 9 else {digit} * 2 end)) % 10 = 0"
    )


def _privacy_links() -> str:
    words = cat.LOCAL_LINK_WORDS
    kinds = [f"contains(href, {_q(w)})" for w in words["href_words"]] + [f"contains(lower(label), {_q(w)})" for w in words["text_words"]]
    case = "case " + " ".join(f"when {k} then {i}" for i, k in enumerate(kinds)) + " end"
    return f"""with a as (select url as page_url, i, anchors[i] as anchor from (
        select url, anchors, unnest(range(1, len(anchors) + 1)) as i from (
          select url, regexp_extract_all(html, {_q(ANCHOR)}) as anchors from pages))),
      b as (select page_url, i, ({hrefs('anchor')})[1] as href, {rx('anchor', '<[^>]+>', '')} as label from a),
      c as (select page_url, i, {case} as kind, {resolve('page_url', 'href')} as url from b where href <> ''),
      d as (select page_url, url, min(struct_pack(kind := kind, i := i)) as spot from c where kind is not null group by all)
      select page_url, url, row_number() over (partition by page_url order by spot) - 1 as pos from d"""


SQL: dict[str, str] = {
    "ingest_report": f"""select count(*) as total, count(*) filter (error is null) as queued,
        count(*) filter (error is not null) as errors,
        round(count(*) filter (error is null) * 100.0 / count(*), 1)::double as success_rate from {CHECKED}""",
    "ingest_status": f"select email_id, case when error is null then 'queued' else 'error' end as status, error from {CHECKED}",
    "parsed_messages": f"""select email_id, coalesce(raw::json->>'from', raw::json->>'from_email') as from_email,
        raw::json->>'subject' as subject, coalesce(length(raw::json->>'html_content'), -1)::bigint as html_chars
        from (select * from {CHECKED} where error is null)""",
    "quarantine_reasons": f"select error, count(*) as messages from {CHECKED} where error is not null group by error",
    "email_validation": f"""select email_id, address, lower(address) <> 'none' and
        regexp_matches({strip_space('address')}, {_q(rules.VALID_EMAIL)}) as valid from (
          select email_id, case length(from_email) % 4 when 0 then '  ' || from_email || ' ' when 1 then from_email || '.7'
            when 2 then replace(from_email, '@', ' at ') else from_email end as address from {TEXTS})""",
    "strip_html": f"select page_id, {strip('html')} as clean_text from pages",
    "strip_html_parsed": f"select page_id, {strip('html')} as clean_text from pages",
    "strip_tags_basic": f"select page_id, {collapse(rx('html', '<[^>]+>', ''))} as clean_text from pages",
    "collapse_whitespace": f"select doc_id, {collapse('text')} as clean_text from documents",
    "truncate_body": """select doc_id, length(t)::bigint as chars, md5(t) as digest from (
        select doc_id, case when length(text) > 10000 then substr(text, 1, 10000) || '...' else text end as t from documents)""",
    "select_body": f"""select from_email, subject, md5(case when length(html_content) > 0 then {strip('html_content')}
        else coalesce(text_content, '') end) as digest from {ALL}""",
    "clean_page": f"select page_id, case when length(t) > 1000 then md5(t) end as digest from (select page_id, {strip('html')} as t from pages)",
    "sender_domain": f"select from_email, subject, {sender('from_email')} as sender_domain from {ALL}",
    "root_domain_rollup": f"select {root(sender('from_email'))} as root, count(*) as messages from {ALL} group by 1",
    "html_links": f"""select page_id, (i - 1)::bigint as pos, urls[i] as url, 'link' as kind from (
        select page_id, urls, unnest(range(1, len(urls) + 1)) as i from (
          select page_id, {distinct_list('u')} as urls from (select page_id, {hrefs('html')} as u from pages)))""",
    "resolved_links": f"""select page_id, (i - 1)::bigint as pos, urls[i] as url, {host('urls[i]')} as host from (
        select page_id, urls, unnest(range(1, len(urls) + 1)) as i from (
          select page_id, {distinct_list('u')} as urls from (
            select page_id, list_transform({hrefs('html')}, lambda h: {resolve('url', 'h')}) as u from pages)))""",
    "text_urls": f"""select page_id, (i - 1)::bigint as pos, urls[i] as found from (
        select page_id, urls, unnest(range(1, len(urls) + 1)) as i from (select page_id, {note_urls('note')} as urls from {NOTE}))""",
    "merge_urls": f"""select page_id, (i - 1)::bigint as pos, urls[i] as found from (
        select page_id, urls, unnest(range(1, len(urls) + 1)) as i from (
          select page_id, {distinct_list('u')} as urls from (
            select page_id, list_concat(list_transform({hrefs('html')}, lambda h: {resolve('url', 'h')}), {note_urls('note')}) as u from {NOTE})))""",
    "url_hosts": f"""select page_id, array_to_string({distinct_list('h')}, ', ') as hosts from (
        select page_id, list_transform({note_urls('note')}, lambda u: {host('u')}) as h from {NOTE})""",
    "footer_html": f"select page_id, {footer('html')} as footer from pages",
    "footer_html_parsed": f"select page_id, {footer('html')} as footer from pages",
    "footer_text": f"""select doc_id, case when {likely('l', cat.LOCAL_INDICATORS)} then l end as footer,
        case when {likely('l', rules.FOOTER_INDICATORS)} then l end as contact_footer
        from (select doc_id, {last_lines('text')} as l from documents)""",
    "last_lines": f"select doc_id, {last_lines('text')} as lines from documents",
    "likely_footer": f"select {likely('text', cat.LOCAL_INDICATORS)} as likely, count(*) as messages from documents group by 1",
    "extract_metadata": f"""select from_email, subject, {sender('from_email')} as sender_domain,
        coalesce(f, case when {likely('l', rules.FOOTER_INDICATORS)} then l end) as footer_text,
        array_to_string({distinct_list('u')}, ' ') as urls from (
          select from_email, subject, {footer('html_content')} as f, {last_lines('t')} as l, {note_urls('t')} as u from (
            select *, case when html_content is null then text_content else {strip('html_content')} end as t from {ALL}))""",
    "company_names": details("", SIGNATURES, rules.COMPANY_NAME, "c_custkey", "signature", "name"),
    "company_addresses": details("", SIGNATURES, "(?i)" + rules.STREET_ADDRESS, "c_custkey", "signature", "address"),
    "company_phones": details("", "documents", rules.COMPANY_PHONE, "doc_id", "text", "phone"),
    "company_info": " union all ".join(
        details(f"{_q(kind)} as kind, ", f"""(select 'c' || c_custkey as id, signature as body from {SIGNATURES}
            union all select 'd' || doc_id, text from documents)""", pattern, "id", "body", "value")
        for kind, pattern in (
            ("name", rules.COMPANY_NAME), ("address", "(?i)" + rules.STREET_ADDRESS),
            ("phone", rules.COMPANY_PHONE), ("website", "(?i)" + rules.TEXT_URL))),
    "pii_spans": spans(),
    "pii_cards_checked": f"select * from ({spans([r for r in rules.PII_RULES if r.entity_type == 'CREDIT_CARD'])}) where {_luhn('hit')}",
    "pii_thresholds": f"select * from ({spans()}) where score >= case entity_type when 'EMAIL_ADDRESS' then 0.5 when 'PHONE_NUMBER' then 0.85 when 'CREDIT_CARD' then 0.8 else 0.35 end",
    "pii_overlap": f"""with s as ({spans(cat.LOOSE_RULES)}) select * from s where not exists (
        select 1 from s t where t.doc_id = s.doc_id and t.start <= s.start and t.stop >= s.stop and t.score >= s.score
          and (t.rule <> s.rule or t.start <> s.start)
          and (t.start < s.start or t.stop > s.stop or t.score > s.score or t.rule < s.rule))""",
    "pii_mask": rewrite_all(_STAR, "t as masked"),
    "pii_replace": rewrite_all(_RED, "md5(t) as digest"),
    "pii_hash": rewrite_all(_SHA, "md5(t) as digest"),
    "pii_default_rewrite": rewrite_steps(
        "documents", "doc_id", "text", {"CREDIT_CARD": _STAR, "EMAIL_ADDRESS": _STAR, "PHONE_NUMBER": _STAR}, "md5(t) as digest"),
    "pii_extract": " union all ".join(
        f"select distinct doc_id, {_q(kind)} as kind, unnest(list_concat("
        + ", ".join(f"regexp_extract_all(text, {_q(p)})" for p in patterns) + ")) as value from documents"
        for kind, patterns in _VALUES_OF),
    "pii_stats": f"select entity_type, count(*) as spans from ({spans()}) group by 1",
    "pii_by_language": f"select lang, entity_type, count(*) as spans from ({spans()}) join documents using (doc_id) group by all",
    "pii_conversations": f"select role, entity_type, count(*) as spans from ({spans(source='conversations', key='role')}) group by all",
    "embedding_text": rewrite_steps(
        f"(select page_id, url, html, {footer('html')} as f, {strip('html')} as x from pages)", "page_id, url, f", "x",
        {e: _STAR for e in ENTITIES},
        f"t || chr(10) || 'Domain: ' || lower({host('url')}) || coalesce(chr(10) || 'Footer: ' || f, '') || chr(10) || 'URL domains: ' || {host('url')} as document",
    ).replace("select page_id, url, f, t ||", "select page_id, t ||"),
    "hashing_embed": "select doc_id, 256::bigint as size, case when regexp_matches(text, '[\\p{L}\\p{N}_]') then 1.0 else 0.0 end::double as norm from documents",
    "knn_topk": knn(SQL2, 5),
    "knn_cosine": knn(COSINE, 10),
    "knn_cells": knn(SQL2, 5),
    "knn_within": knn(COSINE, 10, "distance < 0.6"),
    "knn_lsh": knn(SQL2, 5),
    "knn_lsh_recall": f"select count(*) as neighbours, true as enough from ({nearest(SQL2, 5)})",
    "domain_weights": f"select q_id, c_id, q_domain, c_domain, domain_weight from ({SCORED})",
    "score_candidates": f"select q_id, c_id, round(similarity, 6) as similarity, round(confidence, 6) as confidence from ({SCORED})",
    "best_match": f"select q_id, c_id, domain_weight, round(similarity, 6) as similarity, round(confidence, 6) as confidence from ({BEST})",
    "match_stats": f"""select count(*) as total_matches, count(*) filter (confidence > 0.3) as confident_matches,
        round(avg(confidence), 3) as avg_confidence, round(avg(similarity), 3) as avg_similarity from ({BEST})""",
    "match_domains": f"select c_domain as sender_domain, count(*) as matches from ({BEST}) group by 1",
    "confident_route": route(BEST),
    "domain_route": route(BEST_RELATED),
    "match_earlier_batches": f"""select q_id, c_id, (c_id % 3)::bigint as c_batch, email_category, round(confidence, 6) as confidence,
        confidence > 0.3 as sure from ({BEST_EARLIER})""",
    "stored_lookup": f"""select 'id ' || id as asked, id, sender_domain, email_category from {RESULTS} where id in (7, 77, 777)
        union all (select 'newest', id, sender_domain, email_category from {RESULTS} where sender_domain = 'u7.example'
          order by processed_at desc, id limit 20)""",
    "retried_messages": """select doc_id, case doc_id % 16 when 3 then 2 when 7 then 3 when 11 then 4 else 1 end::bigint as tries,
        doc_id % 16 = 11 as dead, md5(text) as digest from documents""",
    "labelled_files": f"""select 'news@' || {host('url')} as from_email, url as subject, md5(html) as digest,
        case when page_id % 6 < 5 then {_LABELS}[(page_id % 6 + 1)::int] end as expected_category,
        case when page_id % 6 = 5 then 'other.' else '' end || {host('url')} as expected_domain from pages""",
    "classify_replied": f"""select doc_id, md5({_q(PROMPT_HEAD)} || text || chr(10) || chr(10) || 'Sender domain: ' || source
          || '.example' || chr(10) || 'Footer: No footer' || chr(10) || 'URLs: No URLs') as prompt,
        case when first % 4 = 0 then 'survey' else {keywords('text', rules.CATEGORY_KEYWORDS)} end as category,
        case when first % 4 = 0 then 'N' || first else {company("source || '.example'")} end as name,
        case when first % 4 = 0 then 0.75 else 0.3 end::double as confidence
        from (select *, min(case when doc_id % 4 not in (2, 3) then doc_id end) over (partition by text, source) as first from documents)""",
    "pii_ssn": spans([r for r in rules.PII_RULES if r.entity_type == "SSN"], f"""(select 'c' || c_custkey as id,
        c_name || ', ssn ' || {_SSN} || ' or x' || {_SSN} || ' or ' || {_SSN} || '-1' as text from customer
        union all select 'd' || doc_id, text from documents)""", "id").replace(
        "select id, entity_type, rule, start, start + length(hit) as stop, score, hit from", "select id, start, start + length(hit) as stop, hit from"),
    "index_stats": f"""select field, value, count(*) as documents from (
        select 'sender_domain' as field, sender_domain as value from {INDEX} union all
        select 'email_category', email_category from {INDEX} union all
        select 'business_industry', business_industry from {INDEX}) where value <> '' group by all""",
    "index_totals": f"""select count(*) as total_documents, count(distinct sender_domain) as distinct_sender_domain,
        count(distinct email_category) as distinct_email_category,
        count(distinct business_industry) as distinct_business_industry from {INDEX}""",
    "index_delete": f"select id, sender_domain, email_category from {INDEX} where email_category <> 'survey'",
    "index_peek": f"select id, sender_domain, email_category from {INDEX} order by id limit 20",
    "classify_rules": f"select doc_id, {keywords('text', rules.CATEGORY_KEYWORDS)} as category, {keywords('text', cat.LOCAL_KEYWORDS)} as local_category from documents",
    "classify_whole_words": r"""select doc_id, case
        when regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}\p{M}_])(?:the|der)(?:$|[^\p{L}\p{N}\p{M}_])') then 'survey'
        when regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}\p{M}_])(?:la|le)(?:$|[^\p{L}\p{N}\p{M}_])') then 'marketing'
        else 'personal' end as category from documents""",
    "company_from_domain": f"select from_email, subject, {company(sender('from_email'))} as company from {ALL}",
    "fallback_result": f"""select page_id, {keywords('note', rules.CATEGORY_KEYWORDS)} as category,
        {company(sender("'news@' || " + host('url')))} as name, ({note_urls('note')})[1] as website, 0.3::double as confidence from {NOTE}""",
    "parse_model_json": f"""select id, ok as valid, case when ok then category end as category, case when ok then name end as name,
        case when ok then confidence end as confidence from (
          select *, not cut and category <> 'personal' and confidence <= 1 as ok from {REPLIES})""",
    "privacy_candidates": f"""select site, 'https://' || site || {_PATHS}[i] as url, (i - 1)::bigint as pos from (
        select site, unnest(range(1, 10)) as i from (select distinct {SITE} as site from documents))""",
    "privacy_links": _privacy_links(),
    "dpo_extract": f"select * from (select doc_id, {dpo('text')} as dpo_email from documents) where dpo_email is not null",
    "resolve_site_policy": f"select * from {POLICIES}",
    "resolve_linked_sites": f"select * from {LINKED_POLICIES}",
    "enrich_dpo": f"""select d.doc_id, d.website, coalesce(d.known, p.dpo_email) as dpo_email from (
        select doc_id, case when source <> 'src1' then {SITE} end as website,
          case when lang = 'de' then 'dpo@' || {SITE} end as known from documents) d
        left join {POLICIES} p on p.site = d.website""",
    "flatten_result": f"""select id, email_category, sender_domain as business_name,
        case when email_category <> 'survey' then sender_domain else 'unknown' end as sender_domain,
        confidence_score::decimal(18, 6)::double as confidence_score,
        case when confidence_score > 0.99 then 1 else 0 end::bigint as emails, 0::bigint as phones from {RESULTS}""",
    "get_result": f"select id, sender_domain, processed_at, email_category, round(confidence_score, 6) as confidence from {RESULTS} where id = 77",
    "query_by_domain": f"""select id, processed_at, email_category from {RESULTS} where sender_domain = 'u7.example'
        and processed_at between '2024-01-05 00:00:00' and '2024-01-25 00:00:00' order by processed_at desc, id limit 50""",
    "query_by_domain_strict": f"""select * from (select id, processed_at, email_category from {RESULTS} where sender_domain = 'u7.example'
        order by processed_at desc, id limit 50) where processed_at between '2024-01-05 00:00:00' and '2024-01-25 00:00:00'""",
    "latest_per_domain": f"""select sender_domain, id, processed_at, rank from (
        select *, row_number() over (partition by sender_domain order by processed_at desc, id) as rank from {RESULTS}) where rank <= 3""",
    "result_stats": f"""select 'total' as section, 'results' as name, count(*)::double as value from {RESULTS}
        union all select 'mean', 'confidence_score', round_even(avg(confidence_score)::decimal(28, 12), 3)::double from {RESULTS}
        union all select 'category', email_category, count(*)::double from {RESULTS} group by email_category
        union all (select 'domain', sender_domain, count(*)::double as n from {RESULTS} group by sender_domain
          order by n desc, sender_domain limit 10)""",
    "category_shares": f"""select email_category, count(*) as results,
        round(count(*) * 100.0 / sum(count(*)) over (), 1)::double as percent from {RESULTS} group by 1""",
    "run_summary": f"""select count(*) as results, round(avg(confidence_score), 6) as avg_confidence,
        round(min(confidence_score), 6) as min_confidence, round(max(confidence_score), 6) as max_confidence,
        round(avg(processing_time), 6) as avg_time, round(min(processing_time), 6) as min_time,
        round(max(processing_time), 6) as max_time from {RESULTS}""",
    "high_confidence": f"select id, email_category, round(confidence_score, 6) as confidence from {RESULTS} where confidence_score > 0.8",
    "high_confidence_count": f"select count(*) filter (confidence_score > 0.8) as high_confidence, count(*) as results from {RESULTS}",
    "accuracy_by_model": f"""select model, count(*) as messages, round(avg((predicted = expected)::int), 6) as accuracy,
        round(avg(confidence), 6) as avg_confidence from {PREDICTIONS} join {LABELS} using (doc_id)
        group by model having avg((predicted = expected)::int) >= 0.3""",
    "confusion_matrix": f"select * from {CONFUSION}",
    "class_precision": f"""select model, category, hits, predicted, expected,
        round(case when predicted > 0 then hits / predicted::double end, 6) as precision,
        round(case when expected > 0 then hits / expected::double end, 6) as recall from (
          select model, category, sum(case when c.expected = category and c.predicted = category then messages else 0 end)::bigint as hits,
            sum(case when c.predicted = category then messages else 0 end)::bigint as predicted,
            sum(case when c.expected = category then messages else 0 end)::bigint as expected
          from {CONFUSION} c, (select unnest([{', '.join(_q(c) for c in rules.CATEGORIES)}]) as category) group by model, category)""",
    "compare_providers": f"""select provider, confidence, processing_time,
        row_number() over (order by confidence desc, processing_time, provider) as rank from {PROVIDERS} where success""",
    "providers_by_category": f"""select coalesce(category, 'unknown') as category,
        string_agg(provider, ', ' order by provider) as providers, count(*) as n from {PROVIDERS} where success group by 1""",
    "latency_check": f"""select count(*) as messages, count(*) filter (processing_time >= 10) as too_slow,
        count(*) filter (not confidence_score between 0 and 1) as bad_confidence, round(avg(processing_time), 6) as avg_time,
        avg(processing_time) < 5 and count(*) filter (processing_time >= 10 or not confidence_score between 0 and 1) = 0 as passed
        from {RESULTS}""",
}
_DOC_MASKED = rewrite_steps("documents", "doc_id, lang, source, text", "text", {e: _STAR for e in ENTITIES}, "t").replace(
    "select doc_id, lang, source, text, t from", "select doc_id, lang, source, text, t as masked from")


def _emails(e: str) -> str:
    pattern = next(r.pattern for r in rules.PII_RULES if r.name == "email")
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({e}, {_q(pattern)}))), ' ')"


SQL["process_messages"] = f"""
    select 'd' || doc_id as email_id, 'classifier' as route, {keywords('masked', cat.LOCAL_KEYWORDS)} as email_category,
      {company("lang || '.' || source || '.example'")} as name, null::varchar as website, null::varchar as dpo_email,
      {_emails('text')} as emails, 0.3::double as confidence from ({_DOC_MASKED})
    union all
    select 'p' || page_id, 'match', 'marketing', 'Site ' || domain, website, p.dpo_email, {_emails('clean')}, 1.0::double from (
      select page_id, lower({host('url')}) as domain, {strip('html')} as clean,
        'https://en.src' || (length({host('url')}) % 20) || '.example' as website from pages) m
    left join {POLICIES} p on 'https://' || p.site = m.website"""
SQL["stream_values"] = SQL["pii_extract"]
SQL["url_host_counts"] = f"""select host, links, {root('host')} as root from (
    select lower(host) as host, count(*) as links from ({SQL['resolved_links']}) group by 1)"""
SQL["stream_intake"] = SQL["ingest_status"]
SQL["stored_by_day"] = f"""select id, sender_domain, email_category, strftime(processed_at, '%Y-%m-%d') as day,
    round(confidence_score, 6) as confidence from {RESULTS}"""
SQL["index_batches"] = f"""select id, sender_domain, email_category, case when id % 3 < 2 then 1 else 0 end::int as seen_by_last
    from {INDEX} where id % 5 <> 0"""
