"""DuckDB SQL of the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .urls import ENDINGS, FORMS, LANGUAGES, LISTED_SITES, NUMBERS, RULES
from .warc import REFERENCE


def _uuid(x: str) -> str:
    h = f"md5({x})"
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"


OP5 = rf"""
WITH src AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS body,
         {_uuid("'response|' || coalesce(cast(page_id AS varchar), '') || '|' || coalesce(url, '')")} AS refers_to
  FROM pages
), t1 AS (
  SELECT *, regexp_replace(body, '(?is)<(script|style|head|template|noscript)\b.*?</(script|style|head|template|noscript)\s*>', ' ', 'g') AS a FROM src
), t2 AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(a, '(?s)<!--.*?-->', ' ', 'g'),
    '(?i)<(br|hr)\s*/?>|</(p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|nav|header|footer|title|blockquote|pre)\s*>', chr(10), 'g'),
    '(?s)<[A-Za-z/!?][^>]*>', ' ', 'g') AS b FROM t1
), t2_codes AS (
  SELECT *, list_transform(list_sort(list_distinct(regexp_extract_all(b, '{REFERENCE}'))), lambda r: {{'r': r, 'n': CASE WHEN r[3] IN ('x', 'X') THEN cast('0x' || r[4:-2] AS integer) ELSE cast(r[3:-2] AS integer) END}}) AS refs FROM t2
), t2_read AS (
  SELECT *, list_reduce(list_transform(refs, lambda x: {{'t': x.r, 'c': CASE WHEN x.n > 0 AND x.n <= 1114111 AND NOT x.n BETWEEN 55296 AND 57343 THEN chr(x.n) ELSE chr(65533) END}}), lambda acc, x: {{'t': replace(acc.t, x.t, x.c), 'c': ''}}, {{'t': b, 'c': ''}}).t AS b2 FROM t2_codes
), t3 AS (
  SELECT *, replace(replace(replace(replace(replace(replace(b2, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS c FROM t2_read
), t4 AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(c, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text,
         'sha256:' || sha256(body) AS source_digest, {_uuid("'conversion|' || refers_to")} AS conversion_id,
         regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g') AS title,
         regexp_extract(body, '(?i)<html[^>]*\blang="([A-Za-z-]*)"', 1) AS language
  FROM t3
), both_kinds AS (
  SELECT page_id, 'conversion' AS type, conversion_id AS record_id, refers_to, uri, 'text/plain; charset=utf-8' AS content_type, source_digest, text AS block FROM t4
  UNION ALL
  SELECT page_id, 'metadata', {_uuid("'metadata|' || refers_to")}, refers_to, uri, 'application/warc-fields', source_digest,
         concat('conversion: ', conversion_id, chr(13), chr(10), 'source-content-type: text/html; charset=utf-8', chr(13), chr(10), 'source-payload-digest: ', source_digest, chr(13), chr(10),
                'source-length: ', strlen(body), chr(13), chr(10), 'title: ', title, chr(13), chr(10), 'language: ', language, chr(13), chr(10)) FROM t4
)
SELECT page_id, type, record_id, refers_to, uri, '2024-01-01T00:00:00Z' AS date, content_type, cast(strlen(block) AS bigint) AS length,
       'sha256:' || sha256(block) AS block_digest, source_digest, block
FROM both_kinds
"""

_CASES = "\n".join(
    f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}|{v}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
_VALUES = lambda values: "(SELECT unnest([" + ", ".join(f"'{v}'" for v in values) + "]) AS v)"
OP6 = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path, coalesce(regexp_extract(url, '{_PARTS}', 3), '') AS query
  FROM pages
), q AS (
  SELECT *, array_to_string(list_filter(string_split(substr(query, 2), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&') AS kept FROM p
), c AS (
  SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^(www|m)\.|:(80|443)$', '', 'g') || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical_url,
    CASE
{_CASES}
    END AS fit
  FROM q
), listed AS (
  SELECT s.v || '.example.' || e.v || '/' || l.v || '/' || n.range || f.v AS url
  FROM {_VALUES(LISTED_SITES)} s, {_VALUES(ENDINGS)} e, {_VALUES(LANGUAGES)} l, range({NUMBERS}) n, {_VALUES(FORMS)} f
)
SELECT page_id, host, path, split_part(fit, '|', 1) AS rule,
       coalesce(split_part(fit, '|', 2), CASE WHEN l.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       c.canonical_url, l.url IS NOT NULL AS is_listed
FROM c LEFT JOIN listed l ON c.canonical_url = l.url
"""

ORACLES = {"op5_warc_derivatives": OP5, "op6_url_filter": OP6}
