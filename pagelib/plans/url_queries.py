"""Address rules over every page address and its shape variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelib.functions import urls
from pagelib.plans.registry import query
from pagelib.plans.tables import SQL_VIEWS

_SCHEME = "[A-Za-z][A-Za-z0-9+.\\-]*"
SQL_VIEWS["url_parts"] = f"""
SELECT *, regexp_replace(host, '\\.+$', '') AS bare_host,
  regexp_replace(regexp_replace(host, '\\.+$', ''), '^www\\.', '') AS site,
  scheme IN ('http', 'https') AND host <> '' AND NOT regexp_matches(host, '[\\s<>^|%\\\\]') AS web,
  list_filter(string_split(CASE WHEN raw_path = '' THEN '/' ELSE raw_path END, '/'), lambda x: x <> '')
    AS steps,
  list_transform(string_split(lower(url_decode(CASE WHEN raw_path = '' THEN '/' ELSE raw_path END)), '/'),
    lambda x: x) AS low_steps,
  list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x:
    struct_pack(k := url_decode(replace(string_split(x, '=')[1], '+', ' ')),
      v := url_decode(replace(CASE WHEN contains(x, '=') THEN x[instr(x, '=') + 1:] ELSE '' END, '+', ' '))))
    AS params
FROM (SELECT *, regexp_replace(lower(regexp_replace(authority, '^.*@', '')), ':[0-9]*$', '') AS host,
        regexp_extract(url, '^{_SCHEME}://[^/?#]*([^?#]*)', 1) AS raw_path,
        regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query
      FROM (SELECT *, lower(regexp_extract(url, '^({_SCHEME}):', 1)) AS scheme,
              regexp_extract(url, '^{_SCHEME}://([^/?#]*)', 1) AS authority FROM url_variants))"""


def _q(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


LOCAL = """(regexp_replace(host, '\\.+$', '') = 'localhost'
  OR regexp_replace(host, '\\.+$', '') LIKE '%.localhost'
  OR regexp_matches(host, '^127\\.[0-9]+\\.[0-9]+\\.[0-9]+$') OR host IN ('0.0.0.0', '[::1]', '[::]'))"""
DOMAIN = f"""CASE WHEN scheme = '' OR (scheme IN ('http', 'https') AND NOT web) THEN ''
  WHEN scheme = 'file' OR {LOCAL} THEN NULL ELSE regexp_replace(host, '^www\\.', '') END"""


def _v4(host: str) -> str:
    n = [f"TRY_CAST(string_split({host}, '.')[{i}] AS INTEGER)" for i in (1, 2, 3)]
    a, b, c = n
    return f"""({a} IN (0, 10, 127) OR {a} >= 224 OR ({a} = 100 AND {b} BETWEEN 64 AND 127)
  OR ({a} = 169 AND {b} = 254) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168)
  OR ({a} = 192 AND {b} = 0 AND {c} IN (0, 2)) OR ({a} = 198 AND {b} IN (18, 19))
  OR ({a} = 198 AND {b} = 51 AND {c} = 100) OR ({a} = 203 AND {b} = 0 AND {c} = 113))"""


PRIVATE = f"""CASE WHEN host = '' THEN true
  WHEN regexp_matches(host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN {_v4('host')}
  WHEN host LIKE '[%' THEN CASE
    WHEN contains(host, 'ffff:') THEN {_v4("regexp_extract(host, 'ffff:([0-9.]+)', 1)")}
    ELSE NOT (regexp_matches(host, '^\\[[23][0-9a-f]{{3}}:') AND NOT regexp_matches(host, '^\\[(2002:|2001:(0*:|0*db8:))')) END
  ELSE {LOCAL} OR NOT contains(bare_host, '.')
    OR regexp_matches(bare_host, '\\.(local|localdomain|internal|intranet|lan|home|home\\.arpa|corp)$') END"""


def _engine(name: str) -> str:
    return f"(site = '{name}' OR site LIKE '{name}.%' OR site LIKE '%.{name}')"


SEARCH = f"""(({_engine('google')} AND list_aggregate(low_steps, 'string_agg', '/')
    IN ('/search', '/url', '/imgres', '/webhp'))
  OR ({_engine('duckduckgo')} AND (len(list_filter(params, lambda p: p.k = 'q' AND p.v <> '')) > 0
    OR low_steps[2] LIKE 'html%' OR low_steps[2] LIKE 'lite%'))
  OR (({_engine('baidu')} OR {_engine('amazon')}) AND list_aggregate(low_steps, 'string_agg', '/') = '/s')
  OR (list_has_any(low_steps, ['search', 'results']) AND query <> ''))"""
TOKEN = f"""((contains(authority, '@') AND regexp_extract(authority, '^(.*)@', 1) NOT IN ('', ':'))
  OR len(list_filter(params, lambda p:
    list_has_any(string_split_regex(lower(p.k), '[^a-z0-9]'), [{_q(urls.TOKEN_WORDS)[1:-1]}])
    OR contains(lower(p.k), 'token') OR contains(lower(p.k), 'secret')
    OR contains(lower(p.k), 'password') OR contains(lower(p.k), 'signature')
    OR (starts_with(p.v, 'eyJ') AND strlen(p.v) > 30))) > 0)"""


def _login(words: list[str]) -> str:
    return f"""((contains(bare_host, '.') AND string_split(bare_host, '.')[1] IN {_q(urls.LOGIN_HOST_LABELS)})
  OR list_has_any(list_transform(low_steps, lambda s: string_split(s, '.')[1]), [{_q(words)[1:-1]}]))"""


LOGIN = _login(urls.LOGIN_SEGMENTS)
PERSONAL = "(" + " OR ".join(
    f"bare_host = '{a}' OR ends_with(bare_host, '.{a}')" for a in urls.PERSONAL_APPS) + ")"
VIDEO = """CASE WHEN regexp_matches(CASE WHEN host = 'youtu.be' THEN steps[1]
    WHEN regexp_replace(host, '^(www|m|music)\\.', '') = 'youtube.com' AND steps[1] = 'watch'
      THEN list_filter(params, lambda p: p.k = 'v')[1].v
    WHEN regexp_replace(host, '^(www|m|music)\\.', '') = 'youtube.com' AND steps[1] = 'shorts' THEN steps[2] END,
  '^[A-Za-z0-9_-]{11}$') THEN CASE WHEN host = 'youtu.be' THEN steps[1] WHEN steps[1] = 'watch'
    THEN list_filter(params, lambda p: p.k = 'v')[1].v ELSE steps[2] END END"""
POST = """CASE WHEN regexp_replace(host, '^(www|mobile|m)\\.', '') IN ('x.com', 'twitter.com')
  AND steps[2] = 'status' AND regexp_matches(steps[3], '^[0-9]+$') THEN steps[3] END"""
REPO = f"""CASE WHEN host IN ('github.com', 'www.github.com') AND len(steps) >= 2
    AND lower(steps[1]) NOT IN {_q(urls.NOT_OWNERS)} AND regexp_matches(steps[1], '^[A-Za-z0-9_-]+$')
    AND regexp_matches(steps[2], '^[A-Za-z0-9_.-]+$')
  THEN CASE WHEN len(steps) = 2 THEN lower(steps[1] || '/' || regexp_replace(steps[2], '\\.git$', ''))
    WHEN ((len(steps) = 4 AND steps[3] IN ('issues', 'discussions')) OR (len(steps) >= 4 AND steps[3] = 'pull'))
      AND TRY_CAST(steps[4] AS BIGINT) BETWEEN 1 AND 2147483647
    THEN lower(steps[1] || '/' || steps[2]) || '#' || TRY_CAST(steps[4] AS BIGINT) END END"""
ROUTE = f"""CASE WHEN ({VIDEO}) IS NOT NULL THEN 'youtube'
  WHEN regexp_replace(host, '^(www|m|music)\\.', '') = 'youtube.com'
    AND (steps[1] LIKE '@%' OR steps[1] IN ('channel', 'c', 'user', 'playlist')) THEN NULL
  WHEN ({POST}) IS NOT NULL THEN 'x'
  WHEN regexp_replace(host, '^(www|mobile|m)\\.', '') IN ('x.com', 'twitter.com') THEN NULL
  WHEN ({REPO}) IS NOT NULL THEN 'github' ELSE 'web' END"""
KEY = f"""CASE ({ROUTE}) WHEN 'youtube' THEN 'youtube:' || ({VIDEO})
  WHEN 'x' THEN '{urls.POST_API}' || ({POST}) WHEN 'github' THEN 'github:' || ({REPO})
  WHEN 'web' THEN string_split(url, '#')[1] END"""
TRACKED = f"""(lower(url_decode(replace(string_split(s, '=')[1], '+', ' '))) LIKE 'utm#_%' ESCAPE '#'
  OR lower(url_decode(replace(string_split(s, '=')[1], '+', ' '))) IN {_q(urls.TRACKING)})"""
CLEAN = f"""CASE WHEN web AND trim(url) = url THEN scheme_text || '://' || authority
    || CASE WHEN rtrim(raw_path, '/') = '' THEN '/' ELSE rtrim(raw_path, '/') END
    || CASE WHEN NOT contains(string_split(url, '#')[1], '?') THEN ''
         WHEN len(list_filter(string_split(query, '&'), lambda s: {TRACKED})) = 0 THEN '?' || query
         WHEN len(list_filter(string_split(query, '&'), lambda s: s <> '' AND NOT {TRACKED})) = 0 THEN ''
         ELSE '?' || list_aggregate(list_filter(string_split(query, '&'),
           lambda s: s <> '' AND NOT {TRACKED}), 'string_agg', '&') END
    || regexp_extract(url, '^[^#]*(#[/!].*)$', 1) ELSE url END"""
SQL_VIEWS["clean_urls"] = (
    f"SELECT *, {CLEAN} AS clean FROM (SELECT *, regexp_extract(url, '^({_SCHEME}):', 1) AS scheme_text "
    "FROM url_parts)")
SKIP = f"""CASE WHEN NOT web THEN 'not a web page'
  WHEN page_id % 17 = 0 AND variant = 0 THEN 'forgotten' WHEN {PRIVATE} THEN 'private network'
  WHEN {SEARCH} THEN 'search results' WHEN {TOKEN} THEN 'token in URL' END"""


def _column(name: str, fn, sql: str, source: str = "url_parts"):
    @query(name, f"SELECT page_id, variant, {sql} AS value FROM {source}")
    def run(t):
        return t.url_variants().select("page_id", "variant", fn("url").alias("value"))


_column("domain_of", urls.domain_of, DOMAIN)
_column("is_this_machine", urls.is_this_machine, LOCAL)
_column("clean_key", urls.clean_key, "clean", "clean_urls")
_column("database_url", urls.database_url,
        "regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://)[^/?#]*@', '\\1')")
_column("page_url", urls.page_url, "string_split(url, '#')[1]")
_column("is_private_host", urls.is_private_host, PRIVATE)
_column("is_search_results", urls.is_search_results, SEARCH)
_column("carries_token", urls.carries_token, TOKEN)
_column("is_login_page", urls.is_login_page, LOGIN)
_column("is_login_redirect", urls.is_login_redirect,
        _login(urls.LOGIN_SEGMENTS + urls.REDIRECT_LOGIN_SEGMENTS))
_column("is_personal_app", urls.is_personal_app, PERSONAL)
_column("route_of", urls.route_of, ROUTE)
_column("document_key", urls.document_key, KEY)
_column("host_path", urls.host_path,
        "regexp_replace(host, '^www\\.', '') || rtrim(url_decode(CASE WHEN raw_path = '' THEN '/' "
        "ELSE raw_path END), '/')")


@query("skip_reason", f"""
SELECT coalesce(reason, 'fetch') AS reason, count(*) AS addresses
FROM (SELECT {SKIP} AS reason FROM url_parts) GROUP BY 1""")
def _skip(t):
    forgotten = (F.col("page_id") % 17 == 0) & (F.col("variant") == 0)
    return (t.url_variants().select(urls.skip_reason("url", forgotten).alias("reason"))
            .groupBy(F.coalesce("reason", F.lit("fetch")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("addresses")))


_KEYS = """CASE doc_id % 5
  WHEN 0 THEN 'kmt-git:code.example%2Fo%2F' || source || '//docs/' || doc_id || '%20x.md'
  WHEN 1 THEN 'kmt-blob:sha256-' || sha256(text) WHEN 2 THEN 'kmt-blob:sha256-' || lang
  WHEN 3 THEN 'kmt-git:' || source || '//' ELSE 'https://x.example/' || doc_id END"""


@query("source_kind", f"""
WITH keyed AS (SELECT doc_id, {_KEYS} AS key FROM documents),
split AS (SELECT *, regexp_extract(key, '^kmt-git:(.*?)//(.*)$', 1) AS r,
  regexp_extract(key, '^kmt-git:(.*?)//(.*)$', 2) AS p,
  regexp_extract(key, '^kmt-blob:sha256-([0-9a-f]{{64}})$', 1) AS b FROM keyed)
SELECT doc_id, CASE WHEN r <> '' AND p <> '' THEN 'git' WHEN b <> '' THEN 'blob' ELSE 'web' END AS kind,
  CASE WHEN r <> '' AND p <> '' THEN url_decode(r) END AS repo,
  CASE WHEN r <> '' AND p <> '' THEN url_decode(p) END AS path,
  CASE WHEN b <> '' THEN b END AS sha256 FROM split""")
def _source_kind(t):
    d = t.raw("documents")
    which = F.col("doc_id") % 5
    doc = F.col("doc_id").cast("string")
    key = (F.when(which == 0, F.concat(F.lit("kmt-git:code.example%2Fo%2F"), "source",
                                       F.lit("//docs/"), doc, F.lit("%20x.md")))
           .when(which == 1, F.concat(F.lit("kmt-blob:sha256-"), F.sha2("text", 256)))
           .when(which == 2, F.concat(F.lit("kmt-blob:sha256-"), "lang"))
           .when(which == 3, F.concat(F.lit("kmt-git:"), "source", F.lit("//")))
           .otherwise(F.concat(F.lit("https://x.example/"), doc)))
    parsed = d.select("doc_id", key.alias("key")).withColumn("s", urls.parse_source_key("key"))
    return parsed.select("doc_id", urls.source_kind("key").alias("kind"), "s.repo", "s.path", "s.sha256")


_REMOTE = """CASE doc_id % 7
  WHEN 0 THEN 'git@Host.example:' || lang || '/' || source || '.git'
  WHEN 1 THEN 'https://user:pw@Host.example:8443/' || lang || '/' || source || '.git/'
  WHEN 2 THEN 'ssh://git@host.example/' || lang || '//' || source
  WHEN 3 THEN 'file:///srv/' || source WHEN 4 THEN '/srv/' || source
  WHEN 5 THEN 'https://host.example/' || source || '/../x' ELSE 'C:\\' || source END"""


@query("repo_id", f"""
WITH r AS (SELECT doc_id, {_REMOTE} AS remote FROM documents)
SELECT doc_id, CASE
  WHEN regexp_matches(remote, '^git@') THEN lower(regexp_extract(remote, '@([^:]*):', 1)) || '/'
    || regexp_replace(regexp_extract(remote, ':(.*)$', 1), '\\.git$', '')
  WHEN starts_with(remote, 'https://user') THEN 'host.example/'
    || regexp_extract(remote, '8443/(.*)\\.git/$', 1) END AS repo FROM r""")
def _repo_id(t):
    which = F.col("doc_id") % 7
    remote = (F.when(which == 0, F.concat(F.lit("git@Host.example:"), "lang", F.lit("/"), "source", F.lit(".git")))
              .when(which == 1, F.concat(F.lit("https://user:pw@Host.example:8443/"), "lang", F.lit("/"),
                                         "source", F.lit(".git/")))
              .when(which == 2, F.concat(F.lit("ssh://git@host.example/"), "lang", F.lit("//"), "source"))
              .when(which == 3, F.concat(F.lit("file:///srv/"), "source"))
              .when(which == 4, F.concat(F.lit("/srv/"), "source"))
              .when(which == 5, F.concat(F.lit("https://host.example/"), "source", F.lit("/../x")))
              .otherwise(F.concat(F.lit("C:\\"), "source")))
    return t.raw("documents").select("doc_id", urls.repo_id(remote).alias("repo"))
