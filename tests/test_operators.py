"""Golden cases and invariants of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from leadspark.functions import contacts, records, text, urls
from leadspark.operators import budget, evidence, funnel, leads, pages, quality, rounds, tables


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()[0]


def test_hit_exclusion_cases(spark):
    rows = [
        (1, "de.linkedin.com", "https://de.linkedin.com/x", "A", ""),
        (2, "acme.com", "https://acme.com/list.pdf", "A", ""),
        (3, "acme.com", "https://acme.com/", "Acme tarpaulins", "supplier"),
        (4, "acme.com", "https://acme.com/", "UAE Business Directory", ""),
        (5, "shop.kompass.com", "https://shop.kompass.com/", "A", ""),
        (6, "news.io", "https://news.io/", "Global market report", ""),
        (7, "sub.extra.org", "https://sub.extra.org/", "A", ""),
        (8, "serwis.pl", "https://serwis.pl", "Serwis OGŁOSZENIOWY", ""),
        (9, "notgoogle.com", "https://notgoogle.com/", "A", ""),
    ]
    hits = spark.createDataFrame(rows, "id int, domain string, link string, title string, snippet string")
    out = funnel.mark_excluded(hits, funnel.exclusion_list(spark, [".Extra.org "]), "id")
    assert {r.id: r.excluded for r in out.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: True, 9: False}


def test_funnel_keeps_every_hit_and_counts_gated_domains_as_seen(spark):
    rows = [("c", 1, 1, "α.com", False, False), ("c", 1, 2, "α.com", False, False), ("c", 1, 3, "β.com", False, True), ("c", 2, 1, "α.com", False, False), ("c", 2, 2, "β.com", False, False), ("c", 2, 3, "γ.com", False, False), ("c", 2, 4, "x.com", True, False)]
    hits = spark.createDataFrame(rows, "campaign string, round long, pos long, domain string, x boolean, weak boolean")
    out = funnel.round_counters(funnel.route(hits, F.col("x"), F.col("weak"), ["round", "pos"])).orderBy("round").collect()
    assert [(r.raw, r.excluded, r.duplicate, r.snippet_rejected, r.new) for r in out] == [(3, 0, 1, 1, 1), (4, 1, 2, 0, 1)]
    assert [r.new_domains for r in out] == ["α.com", "γ.com"]


def test_sample_companies_score_as_expected(spark):
    rows = [("cover", 4, 6, "Distributor", True), ("print", 3, 3, "Distributor", True), ("repair", 1, 0, "Retailer", False)]
    own = leads.score(spark.createDataFrame(rows, "id string, products long, scales long, role string, high boolean"))
    own = own.withColumn("status", leads.status(F.col("confidence"), F.col("qualified"))).withColumn("domain", F.col("id"))
    got = {r.id: (r.fit, r.scale, round(r.confidence, 2), r.import_capability, r.status) for r in own.collect()}
    assert got == {"cover": (98, 95, 0.92, "High", "qualified"), "print": (88, 67, 0.88, "High", "qualified"), "repair": (52, 28, 0.80, "Unknown", "rejected")}
    assert [r.id for r in leads.rank_leads(own.withColumn("g", F.lit(1)), ["g"]).orderBy("rank").collect()][-1] == "repair"


def test_country_signals_have_kind_value_and_source(spark):
    companies = spark.createDataFrame([("a", "ae", "X.ae", "https://x.ae/"), ("b", "ae", "y.com", "https://y.com/"), ("c", "sa", "z.com", None), ("d", None, None, None), ("e", "ae", "w.ae", "https://w.ae/")], "company string, country string, domain string, homepage string")
    pages = [("a", 0, "https://x.ae/", "Sharjah branch"), ("a", 1, "https://x.ae/contact", "Dubai office, United Arab Emirates. Acme L.L.C."), ("a", 2, "https://x.ae/more", "dubai again"), ("b", 0, "https://y.com/dubai", "We create value. Dubaian LLCs"), ("c", 0, "https://z.com/", "تقع في المملكة العربية السعودية"), ("d", 0, None, "Dubai"), ("e", 0, "u", None)]
    pages = spark.createDataFrame(pages, "company string, page_index long, url string, text string")
    phones = spark.createDataFrame([("a", 2, "+971 4 1", "https://x.ae/more"), ("a", 1, "+9 71 50 123", "https://x.ae/contact"), ("a", 0, "+1 2", "https://x.ae/"), ("b", 0, "+966 1", "https://y.com/")], "company string, pos long, value string, source_url string")
    profiles = [("ae", ".ae", "+971", ["Abu Dhabi", "Dubai", "Sharjah"], ["UAE", "United Arab Emirates"], ["LLC", "L.L.C.", " "]), ("sa", ".sa", "+966", ["Riyadh"], ["السعودية"], ["CR"])]
    profiles = spark.createDataFrame(profiles, "country string, domain_suffix string, calling_code string, cities array<string>, names array<string>, business_suffixes array<string>")
    got = {r.company: (r.score, r.matched, [tuple(s) for s in r.signals]) for r in funnel.country_score(companies, pages, phones, profiles).collect()}
    contact = "https://x.ae/contact"
    assert got["a"] == (100, True, [("domain", ".ae", "https://x.ae/"), ("phone", "+971", contact), ("city", "Dubai", contact), ("address", "United Arab Emirates", contact), ("business_suffix", "L.L.C.", contact)])
    assert got["b"] == (20, False, [("city", "Dubai", None)])  # in an address only
    assert got["c"] == (25, False, [("address", "السعودية", "https://z.com/")])
    assert got["d"] == (0, False, []) and got["e"] == (25, False, [("domain", ".ae", "https://w.ae/")])


def test_contact_checks(spark):
    yes = F.lit(True)
    assert one(spark, contacts.email_confidence(yes, yes, yes, contacts.role(F.col("v"), F.lit(None).cast("string"))), v="sales@example.ae") == 1.0
    found = quality.validate_phones(spark.createDataFrame([("+971 50 123 4567", "AE"), ("12", "AE")], "value string, iso string")).orderBy("value").collect()
    assert [(r.valid, r.e164) for r in found] == [(True, "+971501234567"), (False, None)]


def test_redaction(spark):
    line = one(spark, records.redact(F.col("v")), v="mail joe.doe@example.com or +971 50 123 4567 with token-abcdefghijkl")
    assert "joe.doe" not in line and "j***@example.com" in line and "***4567" in line and "[REDACTED_TOKEN]" in line
    assert one(spark, records.redact_map(F.create_map(F.lit("apiKey"), F.col("v")))["apiKey"], v="x") == "[REDACTED]"


def test_text_functions(spark):
    assert one(spark, text.normalize(F.col("v")), v="  Ａcme GmbH—Köln ") == "acme gmbh köln"
    assert one(spark, text.term_hits(F.col("v"), ["mesh", "coated fabric", "oem", "importer"]), v="OEM mesh; Coated  fabric. reimporters") == 4
    assert one(spark, text.phrases(F.col("v")), v="Covers (heavy duty), ropes; a") == ["heavy duty", "Covers", "ropes", "Covers (heavy duty), ropes; a"]
    assert one(spark, text.csv_safe(F.col("v")), v="=FORMULA()") == "'=FORMULA()"
    assert one(spark, urls.canonical(F.col("v")), v="https://a.com/b/?utm_source=x&id=1&fbclid=2#top") == "https://a.com/b?id=1"
    assert one(spark, text.canonical_name(F.col("t"), F.col("v"), F.lit("d")), t="About us", v="Acme is a distributor") == "Acme"
    assert one(spark, text.canonical_name(F.col("t"), F.col("v"), F.lit("d")), t="Home", v="Acme Trading supplies covers") == "Acme Trading"


PAGE = """<html><head><title> Acme &amp; Sons </title><script>var x='a@b.com'</script></head><body><nav>menu</nav><div class="cookie-banner">We use cookies</div>
<main><p>{0}</p><p>{0}</p></main><footer>Call sales@acme.com</footer></body></html>""".format("Acme makes covers for trucks. " * 10)


def test_page_text_drops_banners_and_repeats_but_keeps_contacts(spark):
    title, body = pages.read_page(PAGE)
    assert title == "Acme & Sons" and "cookies" not in body and "menu" not in body
    assert body.count("Acme makes covers for trucks. Acme makes") <= 9 and body.split("\n")[-1] == "Call sales@acme.com" and "a@b.com" not in body
    assert len(body.split("\n")) == 2
    assert pages.read_page(None) == (None, "")


def test_chunks_cover_the_text(spark):
    source = " ".join(f"Sentence number {i} stands here." for i in range(200))
    cuts = evidence.cut_points(source)
    assert all(480 <= b - a <= 960 for a, b in cuts[:-1]) and cuts[0][0] == 0 and cuts[-1][1] == len(source)
    assert all(later[0] < earlier[1] for earlier, later in zip(cuts, cuts[1:], strict=False))
    assert evidence.cut_points("") == []


def test_loose_quotes_give_the_page_own_span(spark):
    pages = [("c", 1, 'She  says "hello\u00a0 world" now.'), ("c", 2, "nothing"), ("c", 3, None), ("d", 4, 'says "hello world" now'), ("c", 5, 'She  says "hello\u00a0 world" now.'), ("c", 6, " \n so it goes… – and\ton, it’s late "), (None, 7, "absent quote here"), ("c", 8, "x...y... and more.. of it")]
    quotes = [("c", 1, "says  “hello world”  now"), ("c", 2, "absent quote here"), ("c", 3, "goes... - and on, it's"), ("c", 4, " "), ("c", 5, None), ("c", 6, "goes.. - and"), ("c", 7, "says "), ("c", 8, "says  “hello world”  now"), (None, 9, "absent quote here"), ("c", 10, "y… and more…"), ("c", 11, "oes...\n—  and on"), ("c", 12, "noth—")]
    rows = lambda xs, names: spark.createDataFrame(xs, names)
    out = evidence.locate_quotes_loosely(rows(quotes, "k string, quote_id long, quote string"), rows(pages, "k string, page long, text string"), "k").collect()
    got = {(r.quote_id, r.page): (r.found, r["at"], r.exact, r.quotes, r.pages) for r in out}
    assert len(got) == len(out) and got == {
        (1, 1): ('says "hello\u00a0 world" now', 5, False, 2, 2),
        (3, 6): ("goes… – and\ton, it’s", 9, False, 1, 1),
        (7, 1): ("says ", 5, True, 1, 2),
        (11, 6): ("oes… – and\ton", 10, False, 1, 1),
    }
    none = rows([], "k string, quote_id long, quote string")
    assert evidence.locate_quotes_loosely(none, rows(pages, "k string, page long, text string"), "k").count() == 0


def test_origins_follow_a_plain_walk():
    rng = random.Random(8)
    swaps = {**dict(zip(evidence.TYPOGRAPHIC, evidence.PLAIN, strict=True)), evidence.ELLIPSIS: "..."}
    for _ in range(300):
        text = "".join(rng.choice("ab \n\u00a0…’“—.") for _ in range(rng.randrange(1, 40)))
        plain, places, waiting = "", [], None
        for i, c in enumerate(text):
            if c in evidence.SPACES:
                waiting = i if plain and waiting is None else waiting
                continue
            if waiting is not None:
                plain, places, waiting = plain + " ", [*places, waiting], None
            plain, places = plain + swaps.get(c, c), places + [i] * len(swaps.get(c, c))
        for a in range(len(plain)):
            for b in range(a + 1, len(plain) + 1):
                assert evidence.origin(text, a, b - a) == (places[a], places[b - 1] + 1)


def test_streaks_saturate_and_reset(spark):
    rows = [("a", i, 10, n) for i, n in enumerate([0, 0, 0])] + [("b", i, 10, n) for i, n in enumerate([0, 0, 9, 0, 0])]
    own = rounds.low_yield_streak(spark.createDataFrame(rows, "grp string, round long, raw long, new long"), F.col("new") <= 7)
    got = {(r.grp, r.round): (r.streak, r.saturated) for r in own.collect()}
    assert got["a", 2] == (3, True) and got["b", 4] == (2, False)


def test_saturated_groups_are_not_run_again(spark):
    rows = [("c", "a", r, "same.com") for r in range(6)] + [("c", "b", 7, "new.com")]
    out = rounds.replay_saturation(spark.createDataFrame(rows, "campaign string, grp string, round long, domain string"))
    assert {(r.grp, r.round) for r in out.collect() if r.executed} == {("a", 0), ("a", 1), ("a", 2), ("b", 7)}


@pytest.mark.parametrize("limit", [10_000, 9])
def test_replay_equals_a_plain_loop(spark, limit):
    """Cuts free domains for later rounds of other groups, which moves their own cuts."""
    rng = random.Random(8)
    rows = sorted({(c, g, r, f"{c}{rng.randrange(30 if c == 'x' else 90)}") for c in "xy" for g in "abcd" for r in range(9) for _ in range(rng.randrange(1, 6))})
    want = set()
    for c in "xy":
        seen, streak, ran = set(), {}, 0
        for r, g in sorted({(r, g) for k, g, r, _ in rows if k == c}):
            part = {d for k, q, n, d in rows if (k, q, n) == (c, g, r)}
            run = streak.get(g, 0) < rounds.SATURATED and ran < limit
            new = len(part - seen) if run else 0
            if run:
                seen |= part
                streak[g] = streak.get(g, 0) + 1 if new <= 1 else 0
                ran += 1
            want.add((c, g, r, new, run))
    assert {w[4] for w in want} == {True, False}
    hits = spark.createDataFrame(rows, "campaign string, grp string, round long, domain string")
    assert {tuple(x) for x in rounds.replay_saturation(hits, 1, limit).collect()} == want


def test_budget_passes_over_what_does_not_fit(spark):
    rows = [("c", 1, "x" * 10, False), ("c", 2, "y" * 50, False), ("c", 3, "z" * 10, False)]
    out = rounds.fill_budget(spark.createDataFrame(rows, "k string, pos int, token string, brand boolean"), "k", 30).first()
    assert out.filters == ["x" * 10, "z" * 10] and out.used == 22


def test_brands(spark):
    rows = spark.createDataFrame([("Acme Industrial",), ("Global Trading LLC",), ("Access denied",), ("Dubai covers",)], "v string")
    assert [r.x for r in rows.select(rounds.is_distinctive_brand(F.col("v"), ["covers", "Dubai"]).alias("x")).collect()] == [True, False, False, False]


def test_sections_drop_cut_and_fail(spark):
    rows = [("c", 0, 50, True, False), ("c", 1, 100, False, True), ("c", 2, 500, False, False), ("c", 3, 500, True, False)]
    out = budget.fit_sections(spark.createDataFrame(rows, "k string, pos long, tokens long, required boolean, may_cut boolean"), "k", 100).orderBy("pos").collect()
    assert [(r.action, r.used) for r in out] == [("included", 50), ("truncated", 45), ("dropped", 0), ("failed", 0)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "a", "t0")], "id int, seq int, v string, made string")
    new = spark.createDataFrame([(1, 2, "b", "t1"), (2, 3, "c", "t2")], "id int, seq int, v string, made string")
    got = lambda df: sorted((r.id, r.v, r.made) for r in df.collect())
    once = tables.upsert(old, new, ["id"], "seq", ["v"], ["made"])
    assert got(once) == [(1, "b", "t0"), (2, "c", "t2")]
    assert got(tables.upsert(old.union(new), new, ["id"], "seq", ["v"], ["made"])) == got(once)


def test_all_violations_at_once(spark):
    ls = spark.createDataFrame([("l", "c", 120, 1, 0.5, False)], "lead string, company string, fit long, scale long, confidence double, reviewed boolean")
    fs = spark.createDataFrame([("l", "c", "e1", "p0-s0"), ("l", "c", "e1", "p9-s9")], "lead string, company string, id string, ref string")
    rs = spark.createDataFrame([("l", "p5-s5")], "lead string, ref string")
    cs = spark.createDataFrame([("c", "p0-s0")], "company string, ref string")
    got = {r.rule for r in quality.submission_violations(ls, fs, rs, cs).collect()}
    assert got == {"score_range", "review_required", "unknown_chunk", "duplicate_id", "missing_fact"}


def plain_crawl(edges, pages, redirects, budget, hops=5):
    """One queue per site, as a crawler runs it."""
    out = {}
    for domain in {e[0] for e in edges}:
        moved, there = {u: t for d, u, t in sorted(redirects, reverse=True) if d == domain}, {u for d, u in pages if d == domain}

        def fetch(url):
            for _ in range(hops + 1):
                if url not in moved:
                    return url if url in there else None
                url = moved[url]
            return None

        queue = [(-p, u) for d, s, u, p in edges if d == domain and s is None]
        queue = sorted(q for q in queue if fetch(q[1]))[:1]
        attempted, captured = set(), []
        while queue and len(captured) < budget:
            queue.sort()
            _, url = queue.pop(0)
            if url in attempted:
                continue
            attempted.add(url)
            final = fetch(url)
            if final is None or final in captured:
                continue
            captured.append(final)
            queue += [(-p, u) for d, s, u, p in edges if d == domain and s == final and u not in attempted]
        out |= {(domain, u): i + 1 for i, u in enumerate(captured)}
    return out


@pytest.mark.parametrize("budget", [1, 4, 9])
def test_crawl_frontier_equals_one_queue_per_site(spark, budget):
    rng = random.Random(budget)
    edges, all_pages, redirects = [], [], []
    for d in range(14):
        n = rng.choice([1, 5, 40])
        names = [f"/{rng.randrange(100)}-{i}" for i in range(n)]
        all_pages += [(f"d{d}", u) for u in names if rng.random() < 0.85 or u == names[0]]
        redirects += [(f"d{d}", u, rng.choice(names)) for u in names[1:] if rng.random() < 0.25]
        edges += [(f"d{d}", None, names[0], 0)] + [(f"d{d}", rng.choice(names), rng.choice([*names, "/gone"]), rng.choice([50, 60, 90, 95, 100, 110])) for _ in range(6 * n)]
    e = spark.createDataFrame(edges, "domain string, src string, url string, priority long")
    p, r = spark.createDataFrame(all_pages, "domain string, url string"), spark.createDataFrame(redirects, "domain string, url string, to string")
    got = {(x.domain, x.url): x["rank"] for x in pages.crawl_frontier(e, p, budget, r).collect()}
    assert got == plain_crawl(edges, all_pages, redirects, budget)
    if budget == 4:
        got = {(x.domain, x.url): x["rank"] for x in pages.crawl_frontier(e, p, budget).collect()}
        assert got == plain_crawl(edges, all_pages, [], budget)
        assert pages.crawl_frontier(e.limit(0), p, budget, r).count() == 0


def test_redirects_are_followed_to_their_end(spark):
    chain = [("d", f"/{i}", f"/{i + 1}") for i in range(7)] + [("d", "/a", "/b"), ("d", "/b", "/a"), ("d", "/self", "/self"), ("e", "/0", "/x")]
    got = {(r.domain, r.url): r.final for r in pages.final_urls(spark.createDataFrame(chain, "domain string, url string, to string")).collect()}
    assert got == {("d", f"/{i}"): "/7" if i >= 2 else None for i in range(7)} | {("d", "/a"): None, ("d", "/b"): None, ("d", "/self"): None, ("e", "/0"): "/x"}


@pytest.mark.parametrize("name", ["round_counters", "lead_ranking", "evidence_topk"])
def test_results_do_not_depend_on_partitions(spark, name):
    from leadspark.plans import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_only_the_llm_modules_name_the_llm_package():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "leadspark"
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "llm" in p.read_text()]
    assert users == []


def test_page_gate_sees_phrases_across_pages(spark):
    long = "x" * 500
    rows = [("a", 0, f"{long} truck"), ("a", 1, f"cover {long}"), ("b", 0, f"{long} truck"), ("b", 1, f"no cover {long}"), ("c", 0, "short")]
    out = funnel.page_gate(spark.createDataFrame(rows, "company string, page_index long, text string"), ["truck cover"], [], [], False)
    assert {r.company: r.skipped for r in out.collect()} == {"a": False, "b": True, "c": False}


def test_strings_are_found_as_by_comparing_all_pairs(spark):
    rng = random.Random(5)
    texts = [("c" + str(i % 3), i, "".join(rng.choice("ab é梦") for _ in range(rng.randrange(0, 300)))) for i in range(60)]
    texts += [("c1", 60 + i, texts[1][2]) for i in range(3)] + [("c1", 70, None), (None, 71, "ab")]
    cut = [(c, t[a : a + n]) for c, _, t in texts[:60] for n in (0, 1, 2, 3, 5, 9, 17, 47, 48, 90, 400) for a in [rng.randrange(0, 40)]]
    quotes = [(c, i, q) for i, (c, q) in enumerate([*cut, ("c0", "nowhere at all"), ("c0", None)])]
    got = evidence.locate_quotes(spark.createDataFrame(quotes, "c string, quote_id long, quote string"), spark.createDataFrame(texts, "c string, page long, text string"), "c").collect()
    want = [(i, p, t.find(q)) for c, i, q in quotes for k, p, t in texts if c == k and t is not None and q is not None and q in t]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_quotes_of_all_documents_are_located(spark):
    from leadspark.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    want = [(a.doc_id, b.doc_id, b.text.find(a.text[40:100])) for a in rows for b in rows if len(a.text) >= 120 and a.source == b.source and a.text[40:100] in b.text]
    assert sorted(tuple(r) for r in QUERIES["quote_locate"](spark, sf).collect()) == sorted(want)
    ids = {r.quote_id for r in QUERIES["quote_locate_fuzzy"](spark, sf).where("quote_id = page or pages > 1").collect()}
    assert ids and ids <= {a.doc_id for a in rows if len(a.text) >= 120}


def test_prior_quotes_of_all_documents(spark):
    import re

    from leadspark.plans import QUERIES
    from leadspark.plans.entity_queries import chunks

    sf = "/root/testdata/sf0.001"

    def flat(x):
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", x).strip(" ")

    quotes = {(r.source, flat(r.text[:60])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = []
    for r in chunks(spark, sf).collect():
        f = flat(r.text)
        if any(c == r.company and len(q) >= 16 and (q in f or f in q or q[:48] in f) for c, q in quotes):
            want.append((r.company, r.ref))
    assert sorted(tuple(r) for r in QUERIES["prior_quote_semi"](spark, sf).collect()) == sorted(want)


def test_query_matrix_reads_all_nations(spark):
    from leadspark.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    part, region, nation = ([r[0] for r in spark.read.parquet(f"{sf}/{t}.parquet").orderBy(k).select(v).collect()] for t, k, v in (("part", "p_partkey", "p_name"), ("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name")))
    want = [f"{p} {r} {n}" for p in part for r in region for n in nation][:200]
    assert [r.query for r in QUERIES["query_matrix"](spark, sf).collect()] == want


def test_terms_far_into_a_text_count(spark, tmp_path):
    from leadspark.plans import QUERIES
    from leadspark.plans.entity_queries import BUYER

    far = "zzz " * 200
    docs = [(3, f"{far}{BUYER[0]} "), (7, far), (13, f"{far}wholesale"), (11, f"{far}contact")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'s' source", "'en' lang").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(1, f"<title>A</title><p>{far}</p>"), (2, f"<title>A</title><p>{far} business directory</p>")]
    spark.createDataFrame(pages, "page_id long, html string").selectExpr("*", "'https://acme.com/' url").write.parquet(f"{tmp_path}/pages.parquet")

    def got(name, key):
        return {r[0]: r[1] for r in QUERIES[name](spark, str(tmp_path)).select(key, {"s": "skipped", "l": "priority", "c": "role", "h": "excluded"}[name[0]]).collect()}

    assert got("snippet_gate", "doc_id")[3] is False
    assert got("contact_role", "doc_id") == {3: "unknown", 7: "general", 13: "sales", 11: "support"}
    rank = got("link_priority", "doc_id")
    assert rank[11] > rank[7]
    assert got("hit_exclusion", "page_id") == {1: False, 2: True}


def test_first_version_submissions_break_each_rule_once(spark):
    base = {"company_id": "a", "candidate_id": "a", "all_read": True, "confidence": 0.9, "qualified": True, "reviewed": False, "recommended": "none"}
    cases = [
        ({}, {}, set()), ({"all_read": False}, {}, {"pages_unread"}), ({"company_id": "b"}, {}, {"company_id"}), ({"confidence": 0.7}, {}, {"review_required"}), ({"qualified": False}, {}, {"review_required"}), ({"confidence": 0.7, "reviewed": True}, {}, set()),
        ({"recommended": "c0"}, {}, set()), ({"recommended": "c1"}, {}, {"recommended_contact"}), ({"recommended": "c7"}, {"chosen": "c7"}, {"recommended_contact", "unknown_contact"}), ({"recommended": None}, {}, set()),
        ({}, {"facts": ("f0", "s1")}, {"duplicate_id"}), ({}, {"facts": ("f1", "s9")}, {"unknown_chunk"}), ({}, {"uses": "f9"}, {"unknown_id"}),
    ]
    subs = [(i, *(base | change).values()) for i, (change, _, _) in enumerate(cases)]
    more = lambda name, rows: rows + [(i, *(x[name] if isinstance(x[name], tuple) else (x[name],))) for i, (_, x, _) in enumerate(cases) if name in x]
    n = range(len(cases))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = quality.submission_v1_violations(
        df(subs, "lead long, company_id string, candidate_id string, all_read boolean, confidence double, qualified boolean, reviewed boolean, recommended string"),
        df(more("chosen", [(i, "c0") for i in n]), "lead long, ref string"),
        df([(i, c) for i in n for c in ("c0", "c1")], "lead long, ref string"),
        df(more("facts", [(i, "f0", "s0") for i in n]), "lead long, id string, ref string"),
        df([(i, s) for i in n for s in ("s0", "s1")], "lead long, ref string"),
        df(more("uses", [(i, "f0") for i in n]), "lead long, id string"),
    ).collect()
    assert {i: {r.rule for r in got if r.lead == i} for i in n} == {i: w for i, (_, _, w) in enumerate(cases)}


def test_cached_analyses_hold_for_all_quotes_and_contacts(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    cached = df([(k,) for k in ("both", "quote gone", "contact gone", "nothing cited", "other page", None)], "key string")
    quotes = df([("both", 1, "alpha"), ("both", 2, "beta"), ("quote gone", 1, "alpha"), ("quote gone", 2, "gamma"), ("contact gone", 1, "alpha"), ("other page", 9, "alpha")], "key string, url long, quote string")
    pages = df([(1, "an alpha page"), (2, "beta"), (2, "a second copy"), (9, None)], "url long, text string")
    contacts = df([("both", "a@x"), ("contact gone", "b@x"), ("quote gone", "a@x")], "key string, value string")
    current = df([("both", "a@x"), ("contact gone", "a@x"), ("quote gone", "a@x")], "key string, value string")
    assert {r.key for r in tables.reusable(cached, quotes, pages, contacts, current).collect()} == {"both", "nothing cited", None}


def test_each_fingerprint_follows_its_own_part(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    made = []
    for text, mail, strategy in (("t", "m", "s"), ("t2", "m", "s"), ("t", "m2", "s"), ("t", "m", "s2"), ("t", None, "s")):
        pages, contacts = df([("a", "u1", text), ("a", "u2", "x"), (None, "u", "y")], "c string, url string, text string"), df([("a", mail)] if mail else [], "c string, value string")
        out = evidence.company_fingerprints(pages.orderBy(F.rand()), ["url", "text"], contacts, ["value"], df([("a", strategy), (None, "s")], "c string, strategy string"), "c").collect()
        assert {r.c for r in out} == {"a", None}
        made.append(next(tuple(r)[1:] for r in out if r.c == "a"))
    same = [[x == y for x, y in zip(made[0], other, strict=True)] for other in made[1:]]
    assert same == [[False, True, False], [True, False, False], [True, True, False], [True, False, False]] and made[4][1] is None


def test_only_keys_of_the_strings_leave_the_texts(spark):
    from leadspark.operators import evidence

    words = [" ".join(f"w{i * 131 + k}" for k in range(200)) for i in range(300)]
    texts = spark.createDataFrame([("a", i, w) for i, w in enumerate(words)] + [("b", 0, words[0]), ("a", 900, None), (None, 901, words[1])], "block string, id long, text string")
    strings = spark.createDataFrame([("a", words[7][40:100]), ("a", "w0 w1 w2 w3 w4"), ("a", "w2"), ("b", words[7][40:100]), ("a", None)], "block string, needle string")
    pairs, own = evidence.meet_strings(strings, texts, "block")
    got = {(r.block, r.needle, r.id) for r in evidence.find_strings(strings, texts, "block").collect()}
    want = {(b, n, i) for b, n in {tuple(r) for r in strings.collect()} if n for tb, i, t in map(tuple, texts.collect()) if t and tb == b and n in t}
    assert got == want
    assert want <= {(r.block, r.needle, r.id) for r in pairs.collect()}
    apart = spark.createDataFrame([("a", words[7][40:100])], "block string, needle string")
    assert evidence.meet_strings(apart, texts, "block")[1].count() < 10  # 300 texts of a have no such key


def test_prior_quotes_seek_short_chunks_alone(spark):
    from leadspark.operators import evidence

    long = "the quoted sentence is here and goes on for a while"
    quotes = spark.createDataFrame([("a", f"  {long}\n"), ("a", "short one"), ("a", None), (None, long)], "company string, quote string")
    chunks = spark.createDataFrame([("a", 1, f"x {long} y " + "z " * 400), ("a", 2, "sentence is  here"), ("a", 3, "other " * 300), ("a", 4, None), ("b", 5, long), ("a", 6, "")], "company string, ref long, text string")
    assert sorted(r.ref for r in evidence.prior_quotes(quotes, chunks, "company").collect()) == [1, 2, 6]


def test_folding_leaves_single_spaces_and_plain_text(spark):
    from leadspark.operators.evidence import SPACES, folded

    texts = ["a b  c", " a\tb ", "a \u00a0\u2003b\u3000c", "\u201ca\u201d \u2014 b\u2026", "", "  ", "a\n\n b", "\u00e9 \u4e2d  \u6587"]
    want = [" ".join(x for x in "".join(" " if c in SPACES else {"\u201c": '"', "\u201d": '"', "\u2014": "-", "\u2026": "..."}.get(c, c) for c in t).split(" ") if x) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", folded(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == want


def test_first_version_submissions_agree_with_sql_on_many_phones_and_nulls(spark, tmp_path):
    import duckdb

    from leadspark.plans import ORACLES, QUERIES

    phones, mails = " ".join(f"+49 170 {i:07d} x" for i in range(60)), " ".join(f"u{i}@ex.com" for i in range(70))
    rows = [(1, phones, "en", "a"), (2, "12345\v67890\v12 the", "en", "a"), (3, mails, "de", "e"), (4, "b" * 82, None, None), (5, "b" * 82, "en", "c"), (6, "", "en", "c"), (7, None, "en", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.when(F.col("doc_id") != 5, F.length("text")))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.lead, r.rule, r.n) for r in QUERIES["submission_v1_violations"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(f"SELECT lead, rule, n FROM ({ORACLES['submission_v1_violations']})").fetchall())
    assert (1, "unknown_contact", 60) in got and (4, "review_required", 1) in got


def test_terms_of_a_text_are_not_shuffled(spark, tmp_path):
    from leadspark.plans import QUERIES

    rows = [(1, "Aa b aa  cc AA Dd cc"), (2, "x y"), (3, None), (None, "ee EE"), (4, "bb cc"), (4, "dd ff BB gg"), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["dedupe_terms"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan
    got = {r.doc_id: (r.n_terms, r.terms) for r in df.collect()}
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got.pop(4)[0] == 5
    assert got == {1: (3, md5("Aa cc Dd")), None: (1, md5("ee"))}


def _most_objects(run) -> int:
    """The most memory, in bytes, that Python objects take while run() goes on."""
    import tracemalloc

    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_chunks_leave_a_task_part_by_part(spark):
    captured = {}

    class Pages:
        schema = spark.createDataFrame([], "company string, page_index long, text string").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            captured["cut"] = f
            return spark.createDataFrame([], schema)

    evidence.chunk_pages(Pages())
    import pyarrow as pa

    texts = [f"{i} " + "word. " * 5000 for i in range(400)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["c"] * len(texts)), pa.array(range(len(texts))), pa.array(texts)], ["company", "page_index", "text"])
    sizes, got = [], []
    for out in captured["cut"]([batch]):
        sizes.append(out.nbytes)
        got += list(zip(*[out.column(c).to_pylist() for c in ("page_index", "i", "chunk")], strict=True))
    assert max(sizes) < 2 * evidence.CUT_CHARS + 200_000 < batch.nbytes
    assert got == [(p, i, t[a:b]) for p, t in enumerate(texts) for i, (a, b) in enumerate(evidence.cut_points(t or ""))]


def test_matching_makes_one_text_an_object_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from leadspark.operators import matching

    captured = {}
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: captured.setdefault("find", f) and (lambda c: c))
    matching.matched(F.lit("x"), [("ab", matching.ANYWHERE), ("b", matching.ANYWHERE), ("zz", matching.WORD)])
    texts = pa.array([f"{i} ab b " + "x" * 20_000 for i in range(500)] + [None, "", "zz"])
    out = []
    assert _most_objects(lambda: out.extend(captured["find"](iter([texts])))) < 2_000_000
    got = out[0].to_pylist()
    assert [r["n"] for r in got[7]] == [0, 1] and got[7][1] == {"n": 1, "at": 3, "times": 2} and got[500:502] == [[], []] and got[502] == [{"n": 2, "at": 0, "times": 1}]


def test_strings_that_begin_alike_meet_their_own_texts_alone(spark):
    """What a join moves grows with the texts that hold a string, not with the pairs of texts that share words with it."""
    quotes = [("k", f"the and of the in of the and to the {i:04d} {i * 7919 % 9973:04d} and so {i:05d} it goes") for i in range(200)]
    texts = [("k", i, f"{i} before {q} after {i}") for i, (_, q) in enumerate(quotes)]
    pairs, _ = evidence.meet_strings(spark.createDataFrame(quotes, "block string, needle string"), spark.createDataFrame(texts, "block string, id long, text string"), "block")
    assert sorted((r.needle, r.id) for r in pairs.collect()) == sorted((q, i) for i, (_, q) in enumerate(quotes))


def test_prior_quotes_that_begin_alike_meet_few_chunks(spark, monkeypatch):
    met = []
    plain = evidence.meet_strings

    def spy(*args):
        pairs, own = plain(*args)
        met.append(pairs.count())
        return pairs, own

    monkeypatch.setattr(evidence, "meet_strings", spy)
    begin = [f"the and of the in of the and {i:04d} {i * 7919 % 9973:04d} and so {i:05d}" for i in range(150)]
    quotes = spark.createDataFrame([("k", f"{b} it goes on") for b in begin], "company string, quote string")
    chunks = spark.createDataFrame([("k", i, f"{i} before {b} after {i} and then some more") for i, b in enumerate(begin[:100])] + [("k", 900, "nothing of the kind is in here, of the and in of the and")], "company string, ref long, text string")
    assert sorted(r.ref for r in evidence.prior_quotes(quotes, chunks, "company").collect()) == list(range(100))
    assert met[0] == 100


def test_every_text_passes_with_the_keys_of_the_strings_it_holds(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    from leadspark.functions import grams

    monkeypatch.setattr(grams, "STEP", 500)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.choice((0, 1, 3, 40, 130, 400)))) for _ in range(80)]
    strings = sorted({t[a : a + n] for t in texts for n in (0, 1, 2, 5, 9, 17, 31, 33, 50, 57, 65, 129, 260) for a in [rng.randrange(max(1, len(t) - n + 1))]})
    seed = lambda n: pa.array([12345] * n, pa.int64())
    (keyed,) = grams.keyed_strings([pa.RecordBatch.from_arrays([pa.array(strings), seed(len(strings))], ["needle", "seed"])])
    bits, content = 20, np.zeros(1 << 14, np.uint64)
    for batch in grams.marked(bits)([keyed.select(["key"])]):
        content[batch.column("word").to_numpy()] |= batch.column("value").to_numpy().view(np.uint64)

    class Shared:
        value = content.tobytes()

    found = {}
    sizes = sorted(set(keyed.column("size").to_pylist()))
    for batch in grams.keyed_texts(sizes, Shared, bits)([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts))), seed(len(texts))], ["text", "id", "seed"])]):
        found |= {i: set(keys) for i, keys in zip(batch.column("id").to_pylist(), batch.column("keys").to_pylist(), strict=True)}
    for string, key in zip(keyed.column("needle").to_pylist(), keyed.column("key").to_pylist(), strict=True):
        for i, text in enumerate(texts):
            if string in text:
                assert key in found[i]
    assert len(sizes) > 9
