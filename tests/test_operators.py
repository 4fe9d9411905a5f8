import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as tx
from quillstream.functions.skew import lookup_join
from quillstream.operators import chunks, diff, glossary, marks, memory, paths, provenance, replies, report, translate
from quillstream.plans import batching


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_changes_and_renames(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("gone", "3"), ("old", "9")], "path string, source_hash string")
    head = spark.createDataFrame([("a", "1"), ("b", "x"), ("new", "4"), ("moved", "9"), ("moved2", "9")], "path string, source_hash string")
    assert rows(diff.changed_files(base, head).select("path", "kind"), "path") == [("b", "Modified"), ("moved", "Renamed"), ("moved2", "Added"), ("new", "Added")]
    assert rows(diff.changes(base, head).where("kind = 'Deleted'").select("path"), "path") == [("gone",), ("old",)]
    assert rows(diff.changed_files(base, head, "n*", ["x"]).select("path")) == [("new",)]
    empty = base.limit(0)
    assert diff.changes(empty, empty).count() == 0 and diff.changes(empty, head).where("kind = 'Added'").count() == 5


def test_base_revision(spark):
    snaps = spark.createDataFrame([("r1", 1), ("r2", 2), ("head", 3), ("later", 4)], "ref string, ts int")
    assert rows(diff.resolve_base(snaps, None, "head")) == [("r2", 2)]
    assert rows(diff.resolve_base(snaps, "r1", "head")) == [("r1", 1)]
    assert rows(diff.resolve_base(snaps, " ", "r1")) == []
    with pytest.raises(Exception, match="could not be resolved"):
        diff.resolve_base(snaps, "nope", "head").collect()


@pytest.mark.parametrize(("pattern", "path", "hit"), [("DRAFT_*.md", "DRAFT_a.md", True), ("DRAFT_*.md", "x/y/DRAFT_a.md", True), ("DRAFT_*.md", "x/a.md", False), ("docs/**", "docs/a/b.md", True), ("docs/**", "other/docs/a.md", False), ("a.md", "x/a.md", True), ("a/b.md", "a\\b.md", True), ("docs/*.md", "docs/a/b.md", False)])
def test_ignore(spark, pattern, path, hit):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(diff.is_ignored(F.col("p"), [pattern])).first()[0] is hit


@pytest.mark.parametrize(("template", "path", "expected"), [("docs/{lang}/{relativePath}", "a.md", "docs/de/a.md"), ("docs/{lang}/{relativePath}", "x/y/a.md", "docs/de/x/y/a.md"), ("{dir}/{filename}.{lang}.{ext}", "x/a.md", "x/a.de.md"), ("{dir}/{filename}.{lang}.{ext}", "a.md", "a.de.md"), ("/{dir}//{filename}{ext}", "x\\.env", "x/.env"), ("{filename}|{ext}", "noext", "noext|")])
def test_output_path(spark, template, path, expected):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(paths.output_path(template, F.lit("de"), F.col("p"))).first()[0] == expected


def test_source_relative_and_languages(spark):
    df = spark.createDataFrame([("/Docs/a.md",), ("docs/b.md",), ("x/c.md",)], "p string")
    assert [r[0] for r in df.select(paths.source_relative(F.col("p"), "docs/")).collect()] == ["a.md", "b.md", "x/c.md"]
    assert paths.languages(" tr, de ,,") == ["tr", "de"]
    with pytest.raises(ValueError):
        paths.languages("tr,tr")


def test_memory(spark):
    new = spark.createDataFrame([("p", "tr", "h", "one", 1), ("p", "tr", "h", "two", 2), ("p", None, "h", "x", 3), ("p", "de", "h", None, 1)], "path string, target_lang string, content_hash string, translated_text string, seq int")
    first = memory.upsert(None, new, "seq")
    assert rows(first) == [("p", "tr", "h", "two")]
    later = new.limit(1).withColumn("translated_text", F.lit("three"))
    assert rows(memory.upsert(first, later, "seq").select("translated_text")) == [("three",)]
    wanted = spark.createDataFrame([("p", "tr", "h", 1), ("p", "tr", "h", 2), ("q", "tr", "h", 3)], "path string, target_lang string, content_hash string, id int")
    assert rows(memory.probe(wanted, first).select("id", "translated_text"), "id") == [(1, "two"), (2, "two"), (3, None)]
    assert memory.hits(wanted, first).count() == 2 and memory.misses(wanted, first).count() == 1


def test_lookup_join_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 100), (None, 101), ("none", 102)], "k string, id int")
    right = spark.createDataFrame([("h", "H", 50), ("c", "C", 1)], "k string, v string, n int")
    for hot in (10, 1000):
        assert lookup_join(left, right, ["k"], "n", hot).count() == 51
        got = lookup_join(left, right, ["k"], "n", hot, "left")
        assert got.count() == 53 and got.where("v is null").count() == 2


def test_batches_against_a_plain_loop(spark):
    rng = random.Random(5)
    data = [(f"g{g}" if g else None, i, rng.choice([1, 2, 10, 30, 70])) for g in range(6) for i in range(rng.choice([1, 40, 300]))]
    df = spark.createDataFrame(data, "path string, ordinal int, tokens long").withColumn("batch_no", F.lit("clash"))
    for hot in (10_000, 39):
        got = {(r.path, r.ordinal): r.batch_no for r in batching.batches(df, ["path"], ["ordinal"], "tokens", 60, hot).collect()}
        assert len(got) == len(data)
        for g in {d[0] for d in data}:
            number, used = -1, 0
            for _, i, t in sorted(d for d in data if d[0] == g):
                if number < 0 or used + t > 60:
                    number, used = number + 1, 0
                used += t
                assert got[g, i] == number
    assert batching.batches(df.limit(0), ["path"], ["ordinal"], "tokens", 60).count() == 0


def test_batches_of_ties_and_nulls(spark):
    data = [("a", 1, 30), ("a", 1, 30), ("a", 2, None), ("a", 3, 0), ("a", 4, 59), ("a", None, 5)]
    df = spark.createDataFrame(data, "path string, ordinal int, tokens long")
    for hot in (10_000, 2):
        got = sorted((r.ordinal if r.ordinal is not None else -1, r.batch_no) for r in batching.batches(df, ["path"], ["ordinal"], "tokens", 60, hot).collect())
        assert got == [(-1, 0), (1, 1), (1, 1), (2, 2), (3, 2), (4, 3)]


def test_token_estimate(spark):
    df = spark.createDataFrame([("",), ("abc",), ("12345678",), ("😀" * 4,)], "t string")
    assert [r[0] for r in df.select(tx.token_estimate(F.col("t"))).collect()] == [1, 1, 2, 2]


HEADER = "<!-- translated-document: source-hash=abc; source-path=docs/a.md; target-lang=tr; generated=2026-01-02T03:04:05.1234567+00:00 -->"


@pytest.mark.parametrize(("content", "ok"), [(HEADER + "\n\nbody", True), (HEADER + "\r\nbody", True), (HEADER, True), ("body", False), (HEADER[:-3], False), (HEADER.replace("target-lang=tr; ", ""), False), (HEADER.replace("2026-01", "20x6-01"), False), (HEADER.replace("abc;", "abc; junk;"), False), ("x\n" + HEADER, False), ("", False), (None, False)])
def test_header_parse(spark, content, ok):
    df = spark.createDataFrame([(content,)], "c string")
    assert (df.select(provenance.parse_header(F.col("c"))).first()[0] is not None) is ok


def test_header_round_trip_and_last_key_wins(spark):
    df = spark.createDataFrame([("h=1", "a b.md", "tr", "2026-01-02T03:04:05.1234567+00:00")], "h string, p string, l string, g string")
    got = df.select(provenance.parse_header(provenance.header(*(F.col(c) for c in "hplg"))).alias("x")).first().x
    assert (got.source_hash, got.source_path, got.target_lang, got.generated_raw) == ("h=1", "a b.md", "tr", "2026-01-02T03:04:05.1234567+00:00")
    twice = spark.createDataFrame([(HEADER.replace("abc;", "abc; source-hash=def;"),)], "c string")
    assert twice.select(provenance.parse_header(F.col("c")).source_hash).first()[0] == "def"
    ts = spark.createDataFrame([(datetime(2026, 1, 2, 3, 4, 5, 123456),)], "t timestamp").select(provenance.generated_text(F.col("t"))).first()[0]
    assert ts == "2026-01-02T03:04:05.1234560Z" or ts.endswith("+00:00")


def test_drift(spark):
    outputs = spark.createDataFrame([("o1", "docs/a.md", "tr", HEADER), ("o2", "docs/a.md", "de", HEADER.replace("abc", "old")), ("o3", "docs/gone.md", "tr", HEADER), ("o4", "docs/a.md", "fr", "no header")], "output_path string, path string, target_lang string, content string")
    sources = spark.createDataFrame([("docs/a.md", "abc")], "path string, source_hash string")
    got = {r.output_path: (r.is_stale, r.reason) for r in provenance.drift(outputs, sources).collect()}
    assert got == {"o1": (False, "Up to date."), "o2": (True, provenance.CHANGED), "o3": (True, "Source file 'docs/gone.md' no longer exists."), "o4": (True, provenance.NO_HEADER)}


TERMS = [(1, "dont_translate", None, "API", None, True), (2, "dont_translate", None, "GitHub", None, False), (3, "mapping", "tr-TR", "repository", "depo", False), (4, "mapping", "tr", "cold start", "soğuk açılış", False), (5, "mapping", "de", "x", None, False), (6, "dont_translate", None, None, None, None)]
TERM_SCHEMA = "term_id int, term_kind string, lang string, src string, tgt string, case_sensitive boolean"


@pytest.mark.parametrize(("source", "answer", "lang", "ids"), [("Use the API.", "API kullan.", "tr", []), ("Use the API.", "Arayüz kullan.", "tr", [1]), ("Use the API.", "CAPITAL", "tr", [1]), ("Use the api.", "x", "tr", []), ("On github", "GITHUB'da", "tr", []), ("A repository", "depoya", "TR", []), ("A repository", "ambar", "tr", [3]), ("A repository", "ambar", "de", []), ("No terms", "x", "tr", []), ("A cold start here", "x", "tr", [4]), (None, "x", "tr", []), ("API", None, "tr", [])])
def test_glossary_warnings(spark, source, answer, lang, ids):
    terms = spark.createDataFrame(TERMS, TERM_SCHEMA)
    pairs = spark.createDataFrame([(1, "p", lang, source, answer)], "id int, path string, target_lang string, source_text string, translated_text string")
    assert sorted(r.term_id for r in glossary.warnings(pairs, terms).collect()) == ids


def test_glossary_by_shuffle(spark, monkeypatch):
    terms = spark.createDataFrame(TERMS, TERM_SCHEMA)
    rows_ = [(n % 3, "p", ["tr", "de"][n % 2], "Use the API of a repository and a cold start on github", ["x", "API depo", "soğuk açılış GitHub"][n % 3]) for n in range(12)]
    pairs = spark.createDataFrame(rows_, "id int, path string, target_lang string, source_text string, translated_text string").withColumn("row", F.lit("clash"))
    want = sorted(map(tuple, glossary.warnings(pairs, terms).collect()), key=repr)
    monkeypatch.setattr(glossary, "BROADCAST_TERMS", 1)
    assert sorted(map(tuple, glossary.warnings(pairs, terms).collect()), key=repr) == want and len(want) > 12


def test_glossary_hints_and_load(spark):
    hints = {r.target_lang: r.hint for r in glossary.hints(spark.createDataFrame(TERMS, TERM_SCHEMA), ["tr", "de"]).collect()}
    assert hints["de"] == glossary.VERBATIM + "API, GitHub. "
    assert hints["tr"] == glossary.VERBATIM + 'API, GitHub. ' + glossary.RENDERED + '"repository" -> "depo", "cold start" -> "soğuk açılış".'
    doc = json.dumps({"version": 1, "case_sensitive": False, "dont_translate": ["API", "api", "SDK"], "custom_mappings": {"tr": {"depot": "dépôt"}}})
    got = glossary.terms_of_json(spark.createDataFrame([(doc,)], "j string"), "j")
    assert sorted((r.term_kind, r.src) for r in got.collect()) == [("dont_translate", "API"), ("dont_translate", "SDK"), ("mapping", "depot")]
    with pytest.raises(Exception, match="empty or invalid"):
        glossary.terms_of_json(spark.createDataFrame([("null",)], "j string"), "j").collect()


def test_replies(spark):
    good = json.dumps({"translations": [{"chunkId": "a", "translatedText": "A"}, {"chunkId": "b", "translatedText": "B"}]})
    df = spark.createDataFrame([(1, good), (2, "not json"), (3, None)], "batch int, reply string")
    assert rows(replies.items(df, "reply").select("batch", "chunk_id", "translated_text"), "batch", "chunk_id") == [(1, "a", "A"), (1, "b", "B")]
    assert [r[0] for r in df.orderBy("batch").select(replies.unparsable("reply")).collect()] == [False, True, True]
    pick = df.where("batch = 1").select(replies.repaired_item(F.col("reply"), F.lit("b")), replies.repaired_item(F.col("reply"), F.lit("zz"))).first()
    assert tuple(pick) == ("B", "A")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "batch int, chunk_id string")
    back = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c"), (2, "a")], "batch int, chunk_id string")
    (only,) = replies.check_ids(asked, back, "batch").collect()
    assert only.message == "Chunk id mismatch in provider response (missing: b; unexpected: c; duplicated: a)."
    assert translate.id_problem(["a", "b"], ["a", "a", "c"]) == only.message and translate.id_problem(["a"], ["a"]) is None


def test_retries():
    calls = []

    class Flaky:
        def __init__(self, faults):
            self.faults = list(faults)

        def translate(self, items, lang, hint, problem):
            calls.append(problem)
            fault = self.faults.pop(0) if self.faults else None
            if isinstance(fault, Exception):
                raise fault
            return fault or translate.FakeTranslator().translate(items, lang)

    go = lambda *faults: translate.translate_batch(Flaky(faults), [("a", "x")], "tr", "", translate.Retry(), lambda s: None)
    assert go() == ({"a": "[tr] x"}, None)
    assert go(*[translate.CallError("busy", s) for s in (429, 500, None)])[0] == {"a": "[tr] x"}
    assert go("no json", '{"translations": []}')[0] == {"a": "[tr] x"} and "missing: a" in calls[-1]
    assert go("x", "x", "x")[0] == {} and go("x", "x", "x")[1]
    calls.clear()
    go(*[translate.CallError("down", 503)] * 99)
    assert len(calls) == 18
    calls.clear()
    go(*[translate.CallError("bad", 400)] * 99)
    assert len(calls) == 3
    assert translate.wait_seconds(0, "7") == 7
    assert translate.wait_seconds(0, "Fri, 02 Jan 2026 00:00:10 GMT", now=datetime(2026, 1, 2, tzinfo=UTC)) == 10
    assert translate.wait_seconds(2, None, jitter=lambda: 0.5) == 12
    assert translate.repair(Flaky([translate.CallError("x", 400)]), ("a", "⟦C0⟧"), "bad", "tr", "", translate.Retry(), lambda s: None) == "bad"


def test_provider_selection():
    assert isinstance(translate.select({}, "fake"), translate.FakeTranslator)
    for env, name in (({}, "auto"), ({}, "nobody")):
        with pytest.raises(ValueError):
            translate.select(env, name)
    translate.register("one", lambda env: translate.FakeTranslator(), "ONE_KEY")
    translate.register("two", lambda env: translate.FakeTranslator(), "TWO_KEY")
    assert translate.select({"ONE_KEY": "k"})
    with pytest.raises(ValueError):
        translate.select({"ONE_KEY": "k", "TWO_KEY": "k"})
    with pytest.raises(ValueError):
        translate.select({}, "one")


def test_heal_status_takes_the_first_attempts(spark):
    data = [("a", 1, "⟦X0⟧", "no"), ("a", 2, "⟦X0⟧", "⟦X0⟧"), ("b", 1, "x", "y"), ("c", 1, "⟦X0⟧", None), ("c", 2, "⟦X0⟧", ""), ("c", 3, "⟦X0⟧", ""), ("c", 4, "⟦X0⟧", "⟦X0⟧")]
    df = spark.createDataFrame(data, "id string, n int, s string, t string")
    assert rows(marks.heal_status(df, ["id"], "s", "t", ["n"]), "id") == [("a", "repaired", 1), ("b", "ok", 0), ("c", "unrecoverable", 2)]


def test_rebuild_isolates_faults(spark):
    docs = spark.createDataFrame([("a", "# T\n\nSee `x` **y**.\n"), ("b", "Text `z`.\n"), ("n", None)], "path string, body string")
    own = chunks.extract(docs, "path", "body")
    assert own.count() == 3 and own.where("chunk_id is null").count() == 0
    said = spark.createDataFrame([("a", 0, "tr", ["[tr] T"]), ("a", 1, "tr", ["lost", "<strong0>v</strong0> ⟦CODE0⟧!"]), ("b", 0, "tr", ["lost", "lost", "lost"]), ("b", 7, "de", ["x"])], "path string, ordinal int, target_lang string, attempts array<string>")
    got = {(r.path, r.target_lang): r for r in chunks.rebuild(docs, "path", "body", said).collect()}
    assert got["a", "tr"].markdown == "# [tr] T\n\n**v** `x`!\n" and got["a", "tr"].repaired == [1]
    assert got["b", "tr"].markdown == "Text `z`.\n" and got["b", "tr"].untranslated == [0]
    assert got["b", "de"].markdown is None and "unknown chunk 7" in got["b", "de"].error


@pytest.mark.parametrize("part", [3, 10_000])
def test_reports_hold_every_event(spark, part):
    lists = {"glossary": sorted([f"g{n:02}" for n in range(25)] + ["g07"] * 9), "stale": ["s1"], "skipped": ["x", "x", "y"]}
    events = spark.createDataFrame([(k, m) for k, v in lists.items() for m in v], "category string, message string")
    messages = report.event_messages(events)
    assert messages.where("category = 'glossary'").count() == 25 and messages.where("message = 'g07'").first().times == 10
    for dry_run, url in ((True, None), (False, "http://x"), (False, None)):
        args = ("docs", 2, dry_run, url, [("tr", 3, 1)], (10, 5))
        found = report.reports(messages, *args, part=part).orderBy("report", "section", "part_no").collect()
        text = {k: "".join(r.text for r in found if r.report == k) for k in ("job", "console", "comment")}
        assert text["job"] == report.job_report(*args, lists)
        assert text["console"] == report.console_report(*args, lists)
        assert text["comment"] == report.comment_report("docs", [("tr", 3, 1)], lists)
    none = report.reports(messages.limit(0), *args).collect()
    assert {r.report for r in none} == {"job", "console", "comment"}


def test_reports(spark):
    langs = [("tr", 3, 1)]
    lists = {"glossary": ["g1"], "stale": ["s1"]}
    job = report.job_report("docs", 2, True, None, langs, (10, 5), lists)
    assert "| tr | 3 | 1 |" in job and "| 10 | 5 | 15 |" in job and "dry run" in job and job.index("Stale") < job.index("Glossary")
    assert "Skipped" not in job and "### Stale" in report.comment_report("docs", langs, lists)
    text = report.console_report("docs", 2, False, "http://x", langs, (0, 0), lists)
    assert "Token usage" not in text and "Pull request: http://x" in text and "  drift warning: s1" in text
    df = spark.createDataFrame([("a%b\r\nc",)], "m string")
    assert df.select(tx.annotation(F.col("m"))).first()[0] == "a%25b%0D%0Ac"
    done = spark.createDataFrame([("tr", True), ("tr", False)], "target_lang string, from_cache boolean")
    assert rows(report.lang_summary(done, ["tr", "de"]), "target_lang") == [("de", 0, 0), ("tr", 2, 1)]
    assert spark.range(1).select(report.exit_code(True, F.lit(1)), report.exit_code(False, F.lit(1)), report.exit_code(True, F.lit(0))).first()[:] == (1, 0, 0)
