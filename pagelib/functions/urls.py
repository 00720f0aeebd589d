"""Address rules as native column expressions.

Addresses are split by one anchored grammar: scheme, authority, path, query,
fragment. Scheme and host compare in lower case. Only dotted decimal IPv4 is
recognised as an IPv4 address; other spellings count as names.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Query names that only say where a click came from.
TRACKING = [
    "fbclid", "gclid", "dclid", "msclkid", "ttclid", "twclid", "gbraid", "wbraid", "yclid",
    "mc_cid", "mc_eid", "igshid", "_hsenc", "_hsmi", "mkt_tok", "vero_id", "vero_conv",
]
# Host suffixes that mean a private network.
PRIVATE_SUFFIXES = [
    ".local", ".localdomain", ".internal", ".intranet", ".lan", ".home", ".home.arpa", ".corp",
]
# Query name words that carry a secret.
TOKEN_WORDS = [
    "token", "code", "key", "apikey", "accesskey", "authcode", "authorizationcode", "sessionkey",
    "resetkey", "secret", "sig", "signature", "auth", "session", "sessionid", "sid", "otp", "reset",
    "verify", "verification", "confirm", "confirmation", "magic", "nonce", "state", "password",
    "pwd", "ticket", "jwt", "credential", "credentials",
]
TOKEN_PARTS = ["token", "secret", "password", "signature"]
# Path steps and host labels of sign-in screens.
LOGIN_SEGMENTS = [
    "login", "log-in", "log_in", "logon", "signin", "sign-in", "sign_in", "signup", "sign-up",
    "sign_up", "register", "sso", "saml", "oauth", "oauth2", "authorize", "verify", "verify-email",
    "verify_email", "verification", "confirm", "confirmation", "activate", "activation", "reset",
    "confirm-email", "confirm_email", "reset-password", "reset_password", "password-reset",
    "password_reset", "forgot-password", "forgot_password", "magic-link", "magic_link", "2fa",
    "mfa", "otp", "servicelogin",
]
REDIRECT_LOGIN_SEGMENTS = ["auth", "account", "accounts", "session", "sessions"]
LOGIN_HOST_LABELS = ["login", "signin", "accounts", "auth", "sso", "idp"]
# Hosts of personal apps.
PERSONAL_APPS = [
    "mail.google.com", "outlook.live.com", "outlook.office.com", "outlook.office365.com",
    "mail.yahoo.com", "mail.proton.me", "app.fastmail.com", "mail.zoho.com", "icloud.com",
    "claude.ai", "chatgpt.com", "chat.openai.com", "gemini.google.com", "aistudio.google.com",
    "grok.com", "meta.ai", "slack.com", "discord.com", "discordapp.com", "web.whatsapp.com",
    "web.telegram.org", "messenger.com", "teams.microsoft.com", "teams.live.com", "chat.google.com",
    "meet.google.com", "docs.google.com", "drive.google.com", "calendar.google.com",
    "keep.google.com", "contacts.google.com", "photos.google.com", "notion.so", "notion.site",
    "onedrive.live.com", "sharepoint.com", "dropbox.com", "linear.app", "figma.com", "airtable.com",
    "trello.com", "atlassian.net", "console.cloud.google.com", "console.tailscale.com",
    "console.instacloud.com", "console.aliyun.com", "cloud.databricks.com", "one.google.com",
    "platform.openai.com",
]
# First path steps on the code host that name no owner.
NOT_OWNERS = [
    "about", "apps", "codespaces", "collections", "copilot", "customer-stories", "dashboard",
    "enterprise", "events", "explore", "features", "issues", "login", "marketplace", "new", "orgs",
    "organizations", "pricing", "pulls", "readme", "resources", "search", "security", "settings",
    "signup", "site", "solutions", "sponsors", "stars", "team", "topics", "trending", "users",
]
# Formats of document and source keys.
POST_API = "https://api.fxtwitter.com/2/status/"
GIT_KEY = "kmt-git:"
BLOB_KEY = "kmt-blob:sha256-"


def _c(url: str | Column) -> Column:
    return F.col(url) if isinstance(url, str) else url


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once; keeps long rules small in generated code."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scheme_of(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority_of(url) -> Column:
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host_of(url) -> Column:
    """Lower case host without user info or port; an IPv6 host keeps its brackets."""
    bare = F.regexp_replace(authority_of(url), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def path_of(url) -> Column:
    p = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def query_of(url) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def is_parseable(url) -> Column:
    """A scheme, and for web and file addresses a usable host part."""
    s = scheme_of(url)
    web = s.isin("http", "https")
    return (s != "") & (~web | is_web(url))


def is_web(url) -> Column:
    h = host_of(url)
    return scheme_of(url).isin("http", "https") & (h != "") & ~h.rlike(r"[\s<>^|%\\]")


def site_host(url) -> Column:
    """The host as one site: without a trailing root dot."""
    return F.regexp_replace(host_of(url), r"\.+$", "")


def _site(url) -> Column:
    return F.regexp_replace(site_host(url), r"^www\.", "")


def form_decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def path_decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _params(url) -> Column:
    parts = F.filter(F.split(query_of(url), "&"), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(
        form_decode(F.regexp_extract(s, r"^([^=]*)", 1)).alias("name"),
        form_decode(F.regexp_extract(s, r"^[^=]*=(.*)$", 1)).alias("value")))


def _this_machine(h: Column) -> Column:
    name = F.regexp_replace(h, r"\.+$", "")
    named = (name == "localhost") | name.endswith(".localhost")
    v4 = h.rlike(r"^127\.\d+\.\d+\.\d+$") | (h == "0.0.0.0")
    v6 = h.rlike(r"^\[(0*:)*:?(0*:)*0*1?\]$") & h.contains(":")
    return named | v4 | v6


def is_this_machine(url) -> Column:
    return F.coalesce(let(host_of(url), _this_machine), F.lit(False))


def domain_of(url) -> Column:
    """Host without `www.`; '' when there is none; NULL for files and this machine."""
    return (F.when(~is_parseable(url), F.lit(""))
            .when((scheme_of(url) == "file") | is_this_machine(url), F.lit(None).cast("string"))
            .otherwise(F.regexp_replace(host_of(url), r"^www\.", "")))


def _is_tracking(segment: Column) -> Column:
    name = F.lower(form_decode(F.regexp_extract(segment, r"^([^=]*)", 1)))
    return name.startswith("utm_") | name.isin(TRACKING)


def clean_key(url) -> Column:
    u = _c(url)
    head = F.regexp_extract(u, r"^([A-Za-z]+://[^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), r"/+$", "")
    has_query = F.regexp_extract(u, r"^[^#?]*(\?)", 1) == "?"
    query = query_of(u)
    parts = F.split(query, "&")
    kept = F.array_join(F.filter(parts, lambda s: (s != "") & ~_is_tracking(s)), "&")
    tail = (F.when(~has_query, F.lit(""))
            .when(~F.exists(parts, _is_tracking), F.concat(F.lit("?"), query))
            .when(kept == "", F.lit(""))
            .otherwise(F.concat(F.lit("?"), kept)))
    route = F.regexp_extract(u, r"^[^#]*(#[/!].*)$", 1)
    plain = is_web(u) & (head != "") & ~u.rlike(r"[\\\x00-\x1f\x7f]") & (F.trim(u) == u)
    return F.when(plain, F.concat(head, F.when(path == "", "/").otherwise(path), tail, route)).otherwise(u)


def database_url(url) -> Column:
    """Without `user:password@`."""
    return F.regexp_replace(_c(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/?#]*@", "$1")


def page_url(url) -> Column:
    return F.substring_index(_c(url), "#", 1)


def _private_v4(h: Column) -> Column:
    return let(F.transform(F.split(h, r"\."), lambda o: o.try_cast("int")), _private_octets)


def _private_octets(octet: Column) -> Column:
    a, b, c = (F.get(octet, F.lit(i)) for i in range(3))
    return (a.isin(0, 10, 127) | (a >= 224)
            | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254))
            | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
            | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19))
            | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)))


def _private_v6(h: Column) -> Column:
    """Everything outside 2000::/3, and the ranges inside it that embed or document."""
    inside = F.regexp_extract(h, r"^\[(.*)\]$", 1)
    first = F.lpad(F.regexp_extract(inside, r"^([0-9a-f]{0,4}):", 1), 4, "0")
    second = F.lpad(F.regexp_extract(inside, r"^[0-9a-f]{0,4}:([0-9a-f]{0,4})", 1), 4, "0")
    mapped = F.regexp_extract(inside, r"^(?:0*:)*:?ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    native = first.rlike(r"^[23]") & ~(
        (first == "2002") | ((first == "2001") & second.isin("0000", "0db8")))
    return F.when(mapped != "", _private_v4(mapped)).otherwise(~native)


def _private(h: Column) -> Column:
    name = F.regexp_replace(h, r"\.+$", "")
    suffix = F.lit(False)
    for s in PRIVATE_SUFFIXES:
        suffix = suffix | name.endswith(s)
    return (F.when(h == "", True)
            .when(h.rlike(r"^\d+\.\d+\.\d+\.\d+$"), _private_v4(h))
            .when(h.startswith("["), _private_v6(h))
            .otherwise(_this_machine(h) | ~name.contains(".") | suffix))


def is_private_host(url) -> Column:
    return let(host_of(url), _private)


def is_search_results(url) -> Column:
    query = query_of(url)
    asks = F.exists(_params(url), lambda p: (p["name"] == "q") & (p["value"] != ""))

    def rule(at: Column) -> Column:
        site, path = at["site"], at["path"]

        def engine(name: str) -> Column:
            return (site == name) | site.startswith(name + ".") | site.endswith("." + name)

        duck = engine("duckduckgo") & (asks | path.startswith("/html") | path.startswith("/lite"))
        own = F.exists(F.split(path, "/"), lambda s: s.isin("search", "results")) & (query != "")
        return ((engine("google") & path.isin("/search", "/url", "/imgres", "/webhp")) | duck
                | ((engine("baidu") | engine("amazon")) & (path == "/s")) | own)

    return let(F.struct(_site(url).alias("site"), F.lower(path_decode(path_of(url))).alias("path")), rule)


def carries_token(url) -> Column:
    info = F.regexp_extract(authority_of(url), r"^(.*)@", 1)
    credentials = (info != "") & (info != ":")

    def secret(p: Column) -> Column:
        name = F.lower(p["name"])
        words = F.split(name, r"[^a-z0-9]")
        hit = F.arrays_overlap(words, F.array(*[F.lit(w) for w in TOKEN_WORDS]))
        for part in TOKEN_PARTS:
            hit = hit | name.contains(part)
        return hit | (p["value"].startswith("eyJ") & (F.octet_length(p["value"]) > 30))

    return credentials | F.exists(_params(url), secret)


def _login_shaped(url, words: list[str]) -> Column:
    h = site_host(url)
    label = F.substring_index(h, ".", 1)
    stems = F.transform(F.split(F.lower(path_decode(path_of(url))), "/"),
                        lambda s: F.substring_index(s, ".", 1))
    return ((h.contains(".") & label.isin(LOGIN_HOST_LABELS))
            | F.exists(stems, lambda s: s.isin(words)))


def is_login_page(url) -> Column:
    return _login_shaped(url, LOGIN_SEGMENTS)


def is_login_redirect(url) -> Column:
    return _login_shaped(url, LOGIN_SEGMENTS + REDIRECT_LOGIN_SEGMENTS)


def is_personal_app(url) -> Column:
    apps = F.array(*[F.lit(a) for a in PERSONAL_APPS])
    return let(site_host(url), lambda h: F.exists(
        apps, lambda a: (h == a) | h.endswith(F.concat(F.lit("."), a))))


def skip_reason(url, forgotten: Column) -> Column:
    """Why an address is never fetched; NULL when it may be."""
    return (F.when(~is_web(url), "not a web page")
            .when(forgotten, "forgotten")
            .when(is_private_host(url), "private network")
            .when(is_search_results(url), "search results")
            .when(carries_token(url), "token in URL"))


def _address(url) -> Column:
    """Host, path steps and parameters of an address, for the document rules."""
    return F.struct(host_of(url).alias("host"),
                    F.filter(F.split(path_of(url), "/"), lambda s: s != "").alias("steps"),
                    _params(url).alias("params"))


def _step(at: Column, i: int) -> Column:
    return F.get(at["steps"], F.lit(i))


def _video_site(at: Column) -> Column:
    return F.regexp_replace(at["host"], r"^(www|m|music)\.", "") == "youtube.com"


def _post_site(at: Column) -> Column:
    return F.regexp_replace(at["host"], r"^(www|mobile|m)\.", "").isin("x.com", "twitter.com")


def _video(at: Column) -> Column:
    v = F.get(F.filter(at["params"], lambda p: p["name"] == "v"), F.lit(0))["value"]
    found = (F.when(at["host"] == "youtu.be", _step(at, 0))
             .when(_video_site(at) & (_step(at, 0) == "watch"), v)
             .when(_video_site(at) & (_step(at, 0) == "shorts"), _step(at, 1)))
    return let(found, lambda f: F.when(f.rlike(r"^[A-Za-z0-9_-]{11}$"), f))


def _lists_videos(at: Column) -> Column:
    first = _step(at, 0)
    return _video_site(at) & F.coalesce(
        first.startswith("@") | first.isin("channel", "c", "user", "playlist"), F.lit(False))


def _post(at: Column) -> Column:
    number = _step(at, 2)
    return F.when(_post_site(at) & (_step(at, 1) == "status") & number.rlike(r"^[0-9]+$"), number)


def _repo(at: Column) -> Column:
    owner, kind, number = _step(at, 0), _step(at, 2), _step(at, 3)
    n = F.size(at["steps"])
    name = F.when(n == 2, F.regexp_replace(_step(at, 1), r"\.git$", "")).otherwise(_step(at, 1))
    good = (at["host"].isin("github.com", "www.github.com") & (n >= 2) & ~F.lower(owner).isin(NOT_OWNERS)
            & owner.rlike(r"^[A-Za-z0-9_-]+$") & name.rlike(r"^[A-Za-z0-9_.-]+$") & ~name.rlike(r"^\.+$"))
    no = number.try_cast("long")
    numbered = number.rlike(r"^[0-9]+$") & no.between(1, 2147483647) & (
        ((n == 4) & kind.isin("issues", "discussions")) | ((n >= 4) & (kind == "pull")))
    full = F.lower(F.concat_ws("/", owner, name))
    return (F.when(good & (n == 2), full)
            .when(good & numbered, F.concat(full, F.lit("#"), no.cast("string"))))


def video_id(url) -> Column:
    """Video id of a video page, else NULL."""
    return let(_address(url), _video)


def post_id(url) -> Column:
    """Post number of a post page, else NULL."""
    return let(_address(url), _post)


def repo_target(url) -> Column:
    """`owner/repo` or `owner/repo#n` in lower case for a repository or numbered thread."""
    return let(_address(url), _repo)


def document_of(url) -> Column:
    """Struct (route, key): how a page is read and what one fetch of it stands for.

    Route is web, x, github or youtube, and NULL for pages that only list documents.
    """
    web_key = page_url(url)

    def choose(d: Column) -> Column:
        return (F.when(d["video"].isNotNull(), F.struct(F.lit("youtube").alias("route"), F.concat(
                    F.lit("youtube:"), d["video"]).alias("key")))
                .when(d["listing"], F.struct(F.lit(None).cast("string").alias("route"),
                                             F.lit(None).cast("string").alias("key")))
                .when(d["post"].isNotNull(), F.struct(F.lit("x").alias("route"), F.concat(
                    F.lit(POST_API), d["post"]).alias("key")))
                .when(d["repo"].isNotNull(), F.struct(F.lit("github").alias("route"), F.concat(
                    F.lit("github:"), d["repo"]).alias("key")))
                .otherwise(F.struct(F.lit("web").alias("route"), web_key.alias("key"))))

    found = let(_address(url), lambda at: F.struct(
        _video(at).alias("video"), _post(at).alias("post"), _repo(at).alias("repo"),
        (_lists_videos(at) | (_post_site(at) & _post(at).isNull())).alias("listing")))
    return let(found, choose)


def route_of(url) -> Column:
    return document_of(url)["route"]


def document_key(url) -> Column:
    return document_of(url)["key"]


def source_kind(key) -> Column:
    s = parse_source_key(key)
    return F.when(s["repo"].isNotNull(), "git").when(s["sha256"].isNotNull(), "blob").otherwise("web")


def parse_source_key(key) -> Column:
    """Struct (repo, path, sha256), all NULL for a web address."""
    k = _c(key)
    repo = F.try_url_decode(F.replace(F.regexp_extract(k, "^" + GIT_KEY + r"(.*?)//(.*)$", 1),
                                      F.lit("+"), F.lit("%2B")))
    path = F.try_url_decode(F.replace(F.regexp_extract(k, "^" + GIT_KEY + r"(.*?)//(.*)$", 2),
                                      F.lit("+"), F.lit("%2B")))
    blob = F.regexp_extract(k, "^" + BLOB_KEY + r"([0-9a-f]{64})$", 1)
    git = F.coalesce((repo != "") & (path != ""), F.lit(False))
    return F.struct(F.when(git, repo).alias("repo"), F.when(git, path).alias("path"),
                    F.when(blob != "", blob).alias("sha256"))


def repo_id(remote) -> Column:
    """`host/owner/repo` of a git remote, NULL for a local path."""
    r = F.trim(_c(remote))
    url_form = r.contains("://")
    scheme = F.lower(F.regexp_extract(r, r"^(.*?)://", 1))
    url_host = F.regexp_replace(F.regexp_replace(
        F.regexp_extract(r, r"^.*?://([^/]*)/", 1), r"^.*@", ""), r":\d*$", "")
    url_path = F.regexp_extract(r, r"^.*?://[^/]*/(.*)$", 1)
    scp = F.regexp_extract(r, r"^([^:/]{2,}):", 1)
    scp_host = F.regexp_replace(scp, r"^.*@", "")
    scp_path = F.regexp_extract(r, r"^[^:/]{2,}:(.*)$", 1)
    host = F.when(url_form, url_host).otherwise(scp_host)
    raw = F.regexp_replace(F.when(url_form, url_path).otherwise(scp_path), r"^/+|/+$", "")
    path = F.regexp_replace(F.regexp_replace(raw, r"\.git$", ""), r"/+$", "")
    bad_step = F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    good = ((scheme != "file") & (host != "") & ~host.rlike(r"[\s\\/:@\x00-\x1f]") & (path != "")
            & ~path.rlike(r"[\s\\\x00-\x1f]") & ~bad_step)
    return F.when(good, F.concat(F.lower(host), F.lit("/"), path))


def host_path(url) -> Column:
    return F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_decode(path_of(url)), r"/+$", ""))
