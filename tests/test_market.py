"""Domains, addresses, phones and search operators: golden cases."""

import ipaddress
import json
import random

from pyspark.sql import functions as F

from leadspark.functions import addresses, contacts, links, urls
from leadspark.operators import evidence, funnel, matching, pages as pagesops, quality, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_registrable_domains_end_at_the_public_suffix(spark):
    cases = {"www.shop.com.sa": "shop.com.sa", "a.b.shop.co.uk": "shop.co.uk", "shop.co.uk": "shop.co.uk", "co.uk": "co.uk", "m.shop.ae": "shop.ae", "shop.gov.ae": "shop.gov.ae", "localhost": "localhost", "x.y.example.com": "example.com"}
    for host, want in cases.items():
        assert one(spark, urls.registrable(F.lit(host))) == want, host
    assert one(spark, contacts.same_domain(F.lit("mail.shop.com.sa"), F.lit("www.shop.com.sa"))) is True
    assert one(spark, contacts.same_domain(F.lit("other.com.sa"), F.lit("shop.com.sa"))) is False
    assert one(spark, contacts.same_domain(F.lit(None).cast("string"), F.lit("shop.com.sa"))) is False


def test_unsafe_urls(spark):
    cases = {
        "https://example.com/a": None, "ftp://example.com": "scheme", "javascript:alert(1)": "scheme", None: "scheme", "http://u:p@example.com": "userinfo", "http:///x": None,
        "http://127.0.0.1/": "address", "http://8.8.8.8:80/": None, "http://172.31.0.1": "address", "http://172.32.0.1": None, "http://999.1.1.1": "host",
        "http://[::1]/": "address", "http://[::ffff:10.0.0.1]/": "address", "http://[::ffff:8.8.8.8]/": None, "http://[fe80::1]/": "address", "http://[fd00::2]:90/": "address",
        "http://[2001:db8::1]/": "address", "http://[2606:4700::1]/": None, "http://[100::5]/": "address", "http://[0:0:0:0:0:0:0:1]/": "address",
    }
    for url, want in cases.items():
        assert one(spark, urls.unsafe_reason(F.lit(url).cast("string"))) == want, url


def test_addresses_count_in_every_spelling(spark):
    cases = {
        "http://2130706433/": "address", "http://0x7f.0.0.1/": "address", "http://127.1/": "address", "http://0177.0.0.1": "address", "http://0x7F000001": "address", "http://10.1": "address", "http://192.168.257": "address", "http://127.0.0.1./": "address",
        "http://[0::1]/": "address", "http://[0:0:0:0:0:ffff:10.0.0.1]/": "address", "http://[::FFFF:7f00:1]/": "address", "http://[::ffff:8.8.8.8]/": None, "http://[::]/": "address", "http://[FE80::1]": "address", "http://[ff02::1]": "address", "http://[1::8]": None,
        "http://host:99999/": "host", "http://host:65535/": None, "http://host:080/": None, "http://host:/": None, "http://4294967296/": "host", "http://1.2.3.4.5/": "host", "http://256.1.1.1/": "host", "http://1.2.65536": "host", "http://09.1.1.1": "host", "http://0x/": "address",
        "http://[1::2::3]/": "host", "http://[12345::]/": "host", "http://[1:2:3]/": "host", "http://[1:2:3:4:5:6:7:8]": None, "http://[1:2:3:4:5:6:7::]": None, "http://[::1.2.3]": "host", "http://[::01.2.3.4]": "host", "http://[::1": "host",
        "http:///127.0.0.1": "address", "http:\\\\127.0.0.1": "address", " http://127.0.0.1 ": "address", "http://exa\nmple.com": None, "http://a b.com/": "host", "http://a%20b.com": "host", "http://": "host", "http://?x": "host", "http://@host/": None, "http://:@host/": None, "http://:p@host/": "userinfo", "HTTP://Example.COM": None,
        "http://1.2.3.com": None, "http://1.example.0x": "host", "javascript:alert(1)": "scheme", "": "scheme", "http://100.64.0.1": "address", "http://100.128.0.1": None, "http://198.19.255.255": "address", "http://255.255.255.255": "address",
    }
    rows = spark.createDataFrame(list(cases.items()), "url string, want string").withColumn("got", urls.unsafe_reason(F.col("url"))).collect()
    assert not [(r.url, r.want, r.got) for r in rows if r.want != r.got]


def test_addresses_equal_the_plain_parser(spark):
    rng = random.Random(8)
    texts = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(40)] + [str(ipaddress.IPv6Address(rng.getrandbits(128) & ~((1 << 16 * rng.randrange(8)) - 1) & rng.getrandbits(128))) for _ in range(60)]
    texts += [ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(20)]
    texts += ["".join(rng.choice("0:1f.g") for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", addresses.ipv6_hex(F.col("t")).alias("six"), addresses.ipv4_hex(F.col("t")).alias("four")).collect()
    for r in rows:
        try:
            ip = ipaddress.ip_address(r.t)
        except ValueError:
            assert r.six is None, r.t
            continue
        want = f"{int(ip) + ((0xFFFF << 32) if ip.version == 4 else 0):032x}"
        assert (r.four if ip.version == 4 else r.six) == want, r.t


def test_ranges_are_joined_by_their_leading_bits(spark):
    rng = random.Random(9)
    ranges = [*addresses.PRIVATE_RANGES, "8.8.0.0/16", "8.8.8.0/24", "8.8.8.8/32", "0.0.0.0/0", "2a00::/11"]
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(80)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(40)] + ["8.8.8.8", "8.8.9.1", "::", "::1", "127.0.0.1", "fe80::1", "10.255.255.255", "11.0.0.0"]
    table = addresses.range_prefixes(spark.createDataFrame([(r,) for r in [*ranges, "no range", "1.2.3.4/40", "1.2.3.4"]], "cidr string"))
    own = spark.createDataFrame([(i,) for i in ips], "ip string").withColumn("a", F.coalesce(addresses.ipv4_hex(F.col("ip")), addresses.ipv6_hex(F.col("ip"))))
    got = {tuple(r) for r in addresses.join_ranges(own, table, "ip", "a").collect()}
    assert got == {(i, r) for i in ips for r in ranges if ipaddress.ip_address(i).version == ipaddress.ip_network(r).version and ipaddress.ip_address(i) in ipaddress.ip_network(r)}


def test_references_resolve_as_the_standard_says(spark):
    base = "http://a/b/c/d;p?q"
    cases = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q",
        ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g",
        "./../g": "http://a/b/g", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x", "mailto:x@y": None, "javascript:void(0)": None, "https://x.com": "https://x.com/", "HTTPS://x.com/a/../b": "https://x.com/b", "\\g": "http://a/g", "%2e%2E/g": "http://a/b/g",
    }
    rows = spark.createDataFrame(list(cases.items()), "ref string, want string").withColumn("got", links.resolve(F.lit(base), F.col("ref"))).collect()
    assert not [(r.ref, r.want, r.got) for r in rows if r.want != r.got]


def test_links_are_read_like_tags(spark):
    html = """<head><base href='/shop/'><script>document.write('<a href="/products/no">x</a>')</script></head><!-- <a href="/contact/no">c</a> -->
    <A data-href="/about/no" class=x HREF = 'about.html'><b>Ab</b>out <i>us</i></A> <a href=contact>Write</a><a title="a > b" href="../products/list?utm_x=1&amp;p=2#top">All
    of <span>them</span></a><a href="https://www.acme.example/team/">We</a><a href="https://other.example/products">x</a><a name="products">none</a>
    <a href="mailto:products@acme.example">m</a><a href="/files/brand.PDF">brand</a><a href="/x1">Contact &amp; branch<a href="/x2">nothing here</a><a href="/x1">team</a><a href="">company"""
    pages = spark.createDataFrame([(1, "https://acme.example/de/index.html", html), (2, "https://acme.example/de/index.html", '<a href="profile">p</a>'), (3, None, html), (4, "https://acme.example", None), (5, "x", "")], "k long, url string, html string")
    got = {(r.k, r.url): r.priority for r in pagesops.related_links(pages, "k").collect()}
    assert got == {
        (1, "https://acme.example/shop/about.html"): 95, (1, "https://acme.example/shop/contact"): 100, (1, "https://acme.example/products/list?p=2"): 90, (1, "https://www.acme.example/team"): 60,
        (1, "https://acme.example/x1"): 100, (1, "https://acme.example/shop"): 95, (2, "https://acme.example/de/profile"): 95,
    }


def test_search_operators_blank_quotes(spark):
    assert one(spark, urls.exclude_brand(F.lit('Acme "Steel"\\Works'))) == '-"Acme Steel Works"'
    assert one(spark, urls.exclude_brand(F.lit('""'))) is None
    assert one(spark, urls.exclude_domain(F.lit("x.ae"))) == "-site:x.ae"


def test_phones_tell_their_country(spark):
    cases = [
        ("+971 50 123 4567", "AE", True, "+971501234567", "AE", True), ("050 123 4567", "AE", True, "+971501234567", "AE", True), ("00966 11 123 4567", "AE", True, "+966111234567", "SA", False), ("+44 20 7946 0958", "GB", True, "+442079460958", "GB", True),
        ("020 7946 0958", "GB", True, "+442079460958", "GB", True), ("+1 416 555 0100", "US", True, "+14165550100", "CA", False), ("+1 (212) 555-0100", "US", True, "+12125550100", "US", True), ("1-212-555-0100", "US", True, "+12125550100", "US", True), ("+7 701 123 45 67", "RU", True, "+77011234567", "KZ", False),
        ("8 495 123 45 67", "RU", True, "+74951234567", "RU", True), ("06 1 123 4567", "HU", True, "+3611234567", "HU", True), ("+999 123 456 789", "AE", False, None, None, False), ("+971 1", "AE", False, None, "AE", False), ("12", "AE", False, None, "AE", False),
        ("030 123456", "XX", None, None, None, False), ("030 123456", None, None, None, None, False), ("none", "AE", False, None, "AE", False), (None, "AE", None, None, "AE", False), ("+39 06 1234 5678", "IT", True, "+390612345678", "IT", True), ("05 0123", "SG", False, None, "SG", False),
    ]
    found = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i long, value string, iso string")
    got = {r.i: (r.valid, r.e164, r.country, r.in_country) for r in quality.validate_phones(found).collect()}
    assert not [(c, got[i]) for i, c in enumerate(cases) if got[i] != c[2:]]
    assert len({n[0] for n in quality.NUMBERING}) == len(quality.NUMBERING) >= 40


def test_suffix_rules_have_wildcards_and_exceptions(spark):
    cases = {"a.b.shop.ck": "b.shop.ck", "shop.ck": "shop.ck", "ck": "ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "x.y.kawasaki.jp": "x.y.kawasaki.jp", "a.x.y.kawasaki.jp": "x.y.kawasaki.jp", "a.city.kawasaki.jp": "city.kawasaki.jp", "kawasaki.jp": "kawasaki.jp", "my.school.k12.ca.us": "school.k12.ca.us", "a.b.pvt.k12.ma.us": "b.pvt.k12.ma.us", "shop.co.uk": "shop.co.uk", "a.shop.com.sa": "shop.com.sa", "a.example.com": "example.com", "localhost": "localhost", "": ""}
    hosts = spark.createDataFrame([(h, w, 1) for h, w in cases.items()] * 2 + [(None, None, 1)], "host string, want string, key int")
    rows = hosts.withColumn("got", urls.registrable(F.col("host"))).collect()
    assert not [(r.host, r.want, r.got) for r in rows if r.want != r.got]
    rules = spark.createDataFrame([(r,) for r in urls.SUFFIX_RULES], "rule string")
    assert {r.host: r.site for r in urls.registrable_by(hosts, rules, "host").collect()} == cases


def plain_places(text, term, rule):
    """All places of a term, overlapping ones too."""
    beside = lambda c: c.isalnum() and (rule == matching.WORD or c.isascii())
    out = []
    for i in range(len(text) - len(term) + 1):
        j = i + len(term)
        if text[i:j] == term and (rule == matching.ANYWHERE or not (i and beside(text[i - 1])) and not (j < len(text) and beside(text[j]))):
            out.append(i)
    return out


def test_dictionaries_are_matched_like_a_plain_search(spark):
    rng = random.Random(4)
    bits = ["a", "ab", "aba", "b", " ", "é", "-", ".", "\U0001f600", "\n", "(x)", "&&", "[a", "9"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(150)] + [None, "", "ab" * 20_000]
    terms = sorted({("".join(rng.choice(bits) for _ in range(rng.randrange(1, 4))), rng.choice([matching.ANYWHERE, matching.WORD, matching.ASCII])) for _ in range(60)})
    rows = [*enumerate(texts), (0, texts[0]), (None, "ab")]
    t, d = spark.createDataFrame(rows, "k long, text string"), spark.createDataFrame([*terms, terms[0], ("", matching.WORD), (None, matching.WORD), ("ab", None)], "term string, rule string")
    want = sorted((k, w, r, found[0], len(found)) for k, x in rows if x and k is not None for w, r in terms if (found := plain_places(x, w, r)))
    for most in (matching.AUTOMATON_BYTES, 0):
        got = sorted(map(tuple, matching.match_terms(t, d, "k", most).collect()))
        assert got == want and len(want) > 300, most
    many = spark.range(1000).selectExpr("concat('zq', id) AS term", "'word' AS rule")
    assert [tuple(r) for r in matching.match_terms(spark.createDataFrame([(1, "a zq17 zq999 zq1000")], "k long, text string"), many, "k").orderBy("at").collect()] == [(1, "zq17", "word", 2, 1), (1, "zq999", "word", 7, 1)]
    assert matching.match_terms(t, d.limit(0), "k").count() == 0 == matching.match_terms(t.limit(0), d, "k").count()


def test_terms_beyond_the_bound_give_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, 0, "steel pipes and steel valves"), (1, 1, "copper wire"), (2, 0, "no such thing"), (1, 2000, "steel")], "company long, page_index long, text string")
    terms = spark.createDataFrame([("product", 0, "steel"), ("product", 1, "wire"), ("scale", 2, "pipes")], "kind string, pos long, term string")
    rows = lambda: sorted(map(tuple, evidence.facts_from_pages(texts, terms).collect()))
    words = lambda: sorted(map(tuple, evidence.lexicon_join(texts.withColumnRenamed("company", "k"), terms, "k").collect()))
    before = rows(), words()
    monkeypatch.setattr(matching, "AUTOMATON_BYTES", 0)
    assert (rows(), words()) == before and (1, "ev-1-4", "product", "steel", 2000) in before[0]


def test_order_holds_beyond_a_thousand(spark):
    parts = spark.createDataFrame([("k", 0, ",".join(f"first{i}" for i in range(1500))), ("k", 1, "second")], "kind string, source_pos int, text string")
    assert funnel.compile_lexicon(parts).first().terms[-1] == "second"
    body = lambda tag, n: json.dumps({"organic": [{"title": tag, "link": f"https://{tag}{i}.example/"} for i in range(n)]})
    hits = funnel.flatten_responses(spark.createDataFrame([("q", 1, body("a", 1200)), ("q", 2, body("b", 1))], "query string, page int, body string"), per_query=5000)
    assert hits.orderBy(F.desc("hit_pos")).first().title == "b" and hits.count() == 1201


def test_rows_are_numbered_like_a_window(spark):
    rows = [(k, i, j) for k in ("a", None, "b") for i in range(40) for j in range(i % 3)] + [("a", None, 0)]
    df = spark.createDataFrame(rows, "k string, i long, j long")
    got = tables.number_rows(df, ["k"], F.floor(F.col("i") / 7), ["i", "j"]).collect()
    want = {(k, i, j): n + 1 for key in ("a", None, "b") for n, (k, i, j) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])))}
    assert {(r.k, r.i, r.j): r["rank"] for r in got} == want


def test_excluded_domains_are_a_plain_list():
    assert len(funnel.EXCLUDED_DOMAINS) == len(set(funnel.EXCLUDED_DOMAINS)) == 43
