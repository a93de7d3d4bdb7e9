"""Column functions on single rows."""

import pytest
from pyspark.sql import functions as F

from visitlens.functions import emails, events as ev, scalars, scores, urls


def value(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or [F.lit(1).alias("x")])
    return df.select(column.alias("out")).first()["out"]


def browser_hash(text):
    """The hash a browser computes, over UTF-16 units."""
    h = 0
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[i:i + 2], "little")) & 0xFFFFFFFF
    h = h - (1 << 32) if h >= 1 << 31 else h
    digits, n = "", abs(h)
    while n:
        n, d = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return ("-" if h < 0 else "") + (digits or "0")


@pytest.mark.parametrize("text", [
    "", "a", "192.168", "10.7", "Mozilla/5.0|en-US|1920x1080|24|300|true|true|Linux",
    "größe ñ", "smile \U0001F600 end", "x" * 500])
def test_hash32(spark, text):
    assert value(spark, scalars.hash32(F.col("t")), t=text) == browser_hash(text)


@pytest.mark.parametrize("ip,want", [
    ("192.168.1.2", "-ycw3ld"), ("2001:db8::1", browser_hash("2001:db8::1")), (None, None), ("", None)])
def test_company_identifier(spark, ip, want):
    assert value(spark, ev.company_identifier(F.col("ip").cast("string")), ip=ip) == want


@pytest.mark.parametrize("url,want", [
    ("https://a.io/p?x=1&x=2", {"x": "2"}),
    ("https://a.io/p?q=a%20b+c&e=&flag", {"q": "a b c", "e": "", "flag": ""}),
    ("https://a.io/p?q=a=b&bad=%zz", {"q": "a=b", "bad": "%zz"}),
    ("https://a.io/p?q=raw space|pipe", {"q": "raw space|pipe"}),
    ("https://a.io/p#x?y=1", None), ("https://a.io/p", None), ("https://a.io/p?", None),
    ("not a url?x=1", None), (None, None)])
def test_url_params(spark, url, want):
    assert value(spark, urls.url_params(F.col("u").cast("string")), u=url) == want


def test_url_parts(spark):
    u = "https://User:pw@Shop.Example.com:8080/a/b%20c?x=1#frag"
    assert value(spark, urls.host(F.col("u")), u=u) == "shop.example.com"
    assert value(spark, urls.path(F.col("u")), u=u) == "/a/b%20c"
    assert value(spark, urls.path(F.col("u")), u="https://a.io") == "/"
    assert value(spark, urls.path(F.col("u")), u="oops") is None
    assert [value(spark, urls.is_url(F.col("u").cast("string")), u=x) for x in (
        "https://a.io", "http://", "mailto:a@b.co", "/relative", "", None)] == [
        True, False, True, False, False, False]


def test_empty_parameter_is_absent(spark):
    p = urls.url_params(F.col("u"))
    assert value(spark, urls.param(p, "utm_medium"), u="https://a.io/?utm_medium=") is None


@pytest.mark.parametrize("referrer,want", [
    (None, "direct"), ("", "direct"), ("https://www.google.com/x", "organic_search_google"),
    ("https://google.facebook.com/", "organic_search_google"),
    ("https://l.facebook.com/", "social_facebook"), ("https://fb.me/x", "social_facebook"),
    ("https://t.co/abc", "social_twitter"), ("https://www.pinterest.com/", "referral_www.pinterest.com"),
    ("https://tfb.org/", "referral_tfb.org"), ("https://site.io/a", "internal"),
    ("https://other.io/a", "referral_other.io"), ("garbage", None)])
def test_channel(spark, referrer, want):
    got = value(spark, ev.channel(F.col("r").cast("string"), F.col("u")), r=referrer, u="https://site.io/b")
    assert got == want


def test_tracking_id(spark):
    got = value(spark, emails.tracking_id_for(F.col("e"), F.lit("camp_001")), e=" John@Acme.com ")
    assert got == "c4d7e063"


@pytest.mark.parametrize("text,want", [
    ("write to A.b+c@X.co.uk, or a.b+c@x.co.uk.", ["a.b+c@x.co.uk"]),
    ('{"mail":"me\\u0040site.org"}', ["me@site.org"]),
    ("to=me%40site.org&n=1", ["me@site.org"]), ("to=x+y%40site.org", ["x+y@site.org"]),
    ("100% of me@site.org", ["me@site.org"]), ("nothing@here", []), ("", []), (None, [])])
def test_emails_in(spark, text, want):
    assert value(spark, emails.emails_in(F.col("t").cast("string")), t=text) == want


def test_hashes(spark):
    import hashlib

    for fn, kind in ((emails.sha256_of, "sha256"), (emails.sha1_of, "sha1"), (emails.md5_of, "md5")):
        want = hashlib.new(kind, "jö@site.org".encode()).hexdigest()
        assert value(spark, fn(F.col("e")), e=" JÖ@Site.org ") == want


def test_scrubbed_fields(spark):
    m = F.create_map(F.lit("Email"), F.lit("a@b.co"), F.lit("note"), F.lit("z" * 150),
                     F.lit("email2"), F.lit("none"))
    out = value(spark, emails.scrubbed_fields(m))
    assert set(out) == {"Email_sha256", "Email_sha1", "Email_md5", "note", "email2"}
    assert len(out["note"]) == 100 and out["email2"] == "none"
    assert value(spark, emails.form_email(m)) == "a@b.co"


@pytest.mark.parametrize("url,want", [
    ("https://www.youtube.com/embed/abc?x=1", "abc"), ("https://youtu.be/xyz", "xyz"),
    ("https://www.youtube.com/watch?t=1&v=q1&z=2", "q1"),
    ("https://www.youtube-nocookie.com/embed/n1/", "n1"), ("https://site.org/a", None)])
def test_video_id(spark, url, want):
    assert value(spark, ev.video_id(F.col("u")), u=url) == want


@pytest.mark.parametrize("text,ok", [
    ("0000aaaa-0000-4000-8000-000000000000", True), ("0000AAAA-0000-4000-8000-00000000000F", True),
    ("0000aaaa00004000800000000000000", False), ("x0000aaaa-0000-4000-8000-000000000000", False)])
def test_valid_uuid(spark, text, ok):
    assert value(spark, ev.valid_uuid(F.col("t")), t=text) == (text if ok else None)


@pytest.mark.parametrize("sessions,pricing,visited,want", [
    (3, True, True, "hot"), (2, False, True, "warm"), (1, True, True, "warm"),
    (1, False, True, "cold"), (0, False, False, "new")])
def test_engagement_rule(spark, sessions, pricing, visited, want):
    assert value(spark, scores.engagement_rule(F.col("s"), F.col("p"), F.col("v")),
                 s=sessions, p=pricing, v=visited) == want


@pytest.mark.parametrize("hours,points", [
    (24, 30), (25, 25), (72, 25), (168, 20), (336, 15), (720, 10), (721, 5)])
def test_recency(spark, hours, points):
    last = F.timestamp_seconds(F.lit(1_700_000_000 - hours * 3600))
    assert value(spark, scores.recency_points(last, F.timestamp_seconds(F.lit(1_700_000_000)))) == points


def test_recency_never_visited(spark):
    assert value(spark, scores.recency_points(F.lit(None).cast("timestamp"), "2024-01-01")) == 0


@pytest.mark.parametrize("score,level", [(80, "burning"), (79.99, "hot"), (60, "hot"), (40, "warm"), (39, "cold")])
def test_levels(spark, score, level):
    assert value(spark, scores.level_of(F.col("s")), s=float(score)) == level


def test_local_time(spark):
    got = {n: value(spark, c) for n, c in ev.local_time(
        F.lit("2024-01-07 01:30:00").cast("timestamp"), F.lit("America/New_York")).items()}
    assert got == {"local_hour": 20, "local_weekday": 6, "is_weekend": True, "is_business_hours": False}
