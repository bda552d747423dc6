import copy
import json
import random

from pyspark.sql import functions as F

from auditlake.functions import fixed
from auditlake.operators import documents, findings
from auditlake.operators.store import stored
from auditlake.plans import freshness, render, rendered, report
from auditlake.plans.catalog import as_of
from auditlake.sources import html


def plain_diff(raw, shown):
    known, runs, run = set((raw or "").lower().split()), [], []
    for word in [*(shown or "").lower().split(), None]:
        if word is None or word in known:
            runs, run = runs + [" ".join(run)] * (len(" ".join(run)) > 3), []
        else:
            run.append(word)
    return " [...] ".join(runs)


def test_text_diff_is_that_of_a_plain_loop(spark):
    draw = random.Random(5)
    words = ["a", "b", "Ünï", "it", "tail", "x" * 40, " ", "\x1c", "c\nd", "a  b", "\t", "É"]
    text = lambda: draw.choice([None, "", " ", " ".join(draw.choices(words, k=draw.randrange(30)))])
    cases = [("a b c", "a new words b x c tail end"), ("", "all new"), ("a", "a"), (None, None)] + [(text(), text()) for _ in range(300)]
    raw = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "url long, text string")
    shown = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(cases)], "url long, text string")
    found = {r.url: r.js_text for r in rendered.text_diff(raw, shown).collect()}
    assert found == {i: plain_diff(r, s) for i, (r, s) in enumerate(cases)}


def test_a_long_page_of_one_repeated_new_word(spark):
    raw, shown = (spark.createDataFrame([(1, t)], "url long, text string") for t in ("old " * 50_000, "old " + "new " * 200_000))
    assert rendered.text_diff(raw, shown).select(F.length("js_text")).first()[0] == 200_000 * 4 - 1


SNAPSHOT = "url string, seq long, text string, content_length long, shadow array<struct<tag: string, length: long>>, load_more int"


def parsed(spark, *pages):
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return html.parse(report.with_sites(rows).select("site", "ord", "url", F.col("html").alias("raw"), "html")).withColumnRenamed("raw", "html")


def test_the_last_rendering_counts_and_nulls_are_empty(spark):
    pages = parsed(spark, ("https://s.example/", "<body>one two</body>"), ("https://s.example/", "<body>three</body>"), ("https://s.example/x", "<body>x</body>"))
    rows = [
        ("https://s.example/", 1, "older words", 0, None, 5), ("https://s.example/", 2, "one three four five", None, [("x-a", 60)], None),
        ("https://s.example/x", 1, None, 7, None, 1), ("https://gone.example/", 1, "not parsed", 0, None, 0), (None, 1, "x", 0, None, 0),
    ]
    found = {r.url: r for r in rendered.pages(pages, spark.createDataFrame(rows, SNAPSHOT)).collect()}
    home, other = found["https://s.example/"], found["https://s.example/x"]
    assert (home.js_preview, home.js_text_length, home.ajax_delta, home.shadow[0].length, home.load_more) == ("four five", 9, 19, 60, 0)
    assert (other.js_preview, other.ajax_delta, other.shadow, other.load_more) == ("", -7, [], 1)
    assert set(found) == {"https://s.example/", "https://s.example/x", "https://gone.example/"}
    assert rendered.pages(pages, spark.createDataFrame([], SNAPSHOT)).count() == 0


def test_a_report_says_what_only_a_browser_saw(spark):
    pages = parsed(spark, ("https://s.example/", "<title>x</title><body>words</body>"))
    seen = spark.createDataFrame([("https://s.example/", 1, "words " + "late price " * 60, 10, [("x-card", 80)], 0)], SNAPSHOT)
    found = stored(findings.make(report.skills(pages, as_of(), report.Inputs(snapshots=seen))[render.SKILL]()))
    known = report.coverage(pages, pages, None, [render.SKILL], [], True)
    sites = known.select("site", "coverage", "pages_audited", F.lit("2026-09-13T00:00:00+00:00").alias("audited_at"))
    row = stored(findings.report(found, sites).join(sites.select("site", "coverage"), "site").select("*", F.to_json(F.struct("*")).alias("json")))
    assert {"Content appears only after JavaScript execution", "Large content block loads late via AJAX", "Key content lives inside Shadow DOM"} <= {f.title for f in row.first().findings}
    assert row.first().coverage.render_available
    # what is written holds, and a document that was tampered with does not
    written = row.select("site", "json")
    assert documents.violations(written).collect() == []
    wrong = written.withColumn("json", F.regexp_replace("json", '"severity":"high"', '"severity":"dire"'))
    assert {r.rule for r in documents.violations(wrong).collect()} == {"enum"}


GOOD = {
    "site": "s", "audited_at": "2026-09-13T00:00:00Z", "pages_audited": 1, "coverage": {}, "summary": {"total_findings": 1, "critical": 0, "high": 1, "medium": 0},
    "findings": [{"id": "a", "title": "t", "severity": "high", "evidence": {"url": "", "source": "html", "observed": ""}, "suggested_action": {"summary": "x", "priority": "P1"}}],
}


def broken(change):
    out = copy.deepcopy(GOOD)
    change(out)
    return json.dumps(out)


def test_report_documents(spark):
    one = lambda key, value: broken(lambda d: d.update({key: value}))
    item = lambda **changes: broken(lambda d: d["findings"][0].update(changes))
    cases = [
        (json.dumps(GOOD), set()), (one("pages_audited", 1.0), set()), (one("audited_at", "2026-09-13T00:00:00.25+00:00"), set()), (one("more", [1]), set()),
        (None, {("json", "$")}), ("{", {("json", "$")}), ('{"site":"a","site":"b"}', {("json", "$")}), ("3", {("type", "$")}), ("null", {("type", "$")}),
        (one("site", None), {("type", "$.site")}), (one("site", ""), {("minLength", "$.site")}), (one("pages_audited", True), {("type", "$.pages_audited")}), (one("pages_audited", "1"), {("type", "$.pages_audited")}),
        (one("pages_audited", -1), {("minimum", "$.pages_audited")}), (one("findings", {}), {("type", "$.findings")}), (one("proactive_improvements", "x"), {("type", "$.proactive_improvements")}),
        (item(severity="HIGH"), {("enum", "$.findings[0].severity")}), (item(severity=1), {("enum", "$.findings[0].severity")}), (item(skill=None), {("type", "$.findings[0].skill")}),
        (item(evidence={"url": "u"}), {("required", "$.findings[0].evidence.source"), ("required", "$.findings[0].evidence.observed")}),
        (broken(lambda d: d["findings"].append(d["findings"][0])), {("unique", "$.findings[id=a]"), ("count", "$.summary.total_findings"), ("count", "$.summary.high")}),
        (broken(lambda d: d["summary"].update(low=2)), {("count", "$.summary.low")}), (one("audited_at", "2026-09-13T00:00:00+02:00"), {("time", "$.audited_at")}), (one("audited_at", "soon"), {("time", "$.audited_at")}),
        (broken(lambda d: d.update(findings=[])), {("count", "$.summary.total_findings"), ("count", "$.summary.high")}),
    ]
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "k int, json string")
    found = {i: set() for i in range(len(cases))}
    for r in documents.violations(rows).collect():
        found[r.k].add((r.rule, r.path))
    assert found == {i: wanted for i, (_, wanted) in enumerate(cases)}


def test_names_of_knowledge_bases(spark):
    entity = spark.createDataFrame([("s", "The Acme, Inc.", []), ("t", "Bolt", []), ("u", "", []), ("v", "Acme", ["https://www.wikidata.org/wiki/Q1"])], "site string, brand string, same_as array<string>")
    rows = [
        ("wikidata", "Zeta", "Q9", "a bank", ["ACME Ltd", None]), ("wikidata", "Acme", "Q7", "an airline", None), ("wikidata", "acme", "Q70", "an airline", None), ("wikidata", "Acme", "Q0", "a fruit", None),
        ("wikipedia", "Bolt Works", None, "a manufacturer", ["Bolt"]), ("wikipedia", None, None, "a bank", None), ("wikipedia", "Inc", None, "a bank", None),
    ]
    known = spark.createDataFrame(rows, "source string, title string, qid string, description string, aliases array<string>")
    found = {r.site: (r.wikipedia_title, r.qid) for r in freshness.grounding(entity, known).collect()}
    assert found == {"s": (None, "Q7"), "t": ("Bolt Works", None), "u": (None, None), "v": (None, "Q1")}
    assert {r.site: r.qid for r in freshness.grounding(entity, known.limit(0)).collect()} == {"s": None, "t": None, "u": None, "v": "Q1"}


def test_tabs_and_folding_sections(spark):
    body = (
        '<div ROLE="TabList" class="nav-tabs"><a role=tab aria-controls="p q">x</a></div><div role=tabpanel id=p></div><ul class="MuiTabs-root"></ul><details id=d data-toggle="tab"><summary class="muicollapse">s</summary></details>'
        '<a data-bs-toggle="collapse" href="#d">y</a><a data-toggle="Tab" href="#d">n</a><section class="tabular">n</section><p id=p>second</p>'
    )
    rows = parsed(spark, ("https://s.example/", f"<body>{body}</body>"), ("https://s.example/e", "")).select("url", render.folds(F.col("page.folds")).alias("f")).collect()
    found = {r.url: [(x.type, x.tag, x.target, x.target_tag) for x in r.f] for r in rows}
    assert found["https://s.example/"] == [
        ("tab", "div", None, None), ("tab", "a", "p", "div"), ("tabpanel", "div", None, None), ("tab_accordion", "ul", None, None), ("details_summary", "details", None, None), ("tab_accordion", "details", None, None),
        ("tab_accordion", "summary", None, None), ("tab_accordion", "a", "d", "details"),
    ]
    assert found["https://s.example/e"] == []
    assert fixed.FOLD_CLASSES[0] == "tab-pane"


def test_documents_are_dealt_out_and_judged_in_linear_time(spark):
    """150,000 documents are no one task's, and a long document costs no more a finding than a short one."""
    import time

    from auditlake.plans import catalog

    assert catalog.QUERIES["json_schema_validate"](spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= 7
    long = dict(GOOD, findings=[dict(GOOD["findings"][0], id=str(i)) for i in range(20_000)], summary={"total_findings": 20_000, "critical": 0, "high": 20_000, "medium": 0})
    began = time.perf_counter()
    assert documents.judge(json.dumps(long), documents.REPORT, True) == []
    assert documents.judge(json.dumps(GOOD) + " x", documents.REPORT, True) == [{"rule": "json", "path": "$"}] == documents.judge('{"site": NaN}', documents.REPORT, True)
    assert time.perf_counter() - began < 5


def test_pages_made_from_small_tables_are_dealt_out(spark):
    from auditlake.plans import catalog_rendered

    pages, _ = catalog_rendered.rendered_site(spark, "/root/testdata/sf0.1")
    assert pages.rdd.getNumPartitions() >= 7
    assert catalog_rendered.parse(pages, "full_text").schema["page"].dataType.names == ["full_text", "error"]


def test_a_name_of_many_entries_is_joined_in_blocks(spark):
    """Every pair of equal keys once, however the entries of a key are cut; keys without entries and without brands give none."""
    named = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "site int, key string")
    entries = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(100)], "c int, key string")
    plain = sorted(tuple(r) for r in named.join(entries, "key").select("site", "c").collect())
    for block in (1, 7, 1000):
        found = freshness.by_name(named, entries, block)
        assert sorted((r.site, r.c) for r in found.collect()) == plain
    widest = freshness.by_name(named, entries, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in widest and freshness.by_name(named, entries.limit(0)).count() == 0


def test_fetch_logs_are_dealt_out(spark, tmp_path):
    from auditlake.plans import catalog_fetch

    spark.range(1, 50_001).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert catalog_fetch.hop_log(spark, str(tmp_path)).rdd.getNumPartitions() == 3
