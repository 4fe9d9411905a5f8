import hashlib
import http.server
import json
import os
import subprocess
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstream import queries as q
from quillstream.operators import memory, paths, translate
from quillstream.plans import engine
from quillstream.sources import files, options, providers, publish, storage
from quillstream.streaming import ingest

EMPTY = "path string, target_lang string, content_hash string, translated_text string"
TERMS = "term_id int, term_kind string, lang string, src string, tgt string, case_sensitive boolean"


def forgetful():
    class Forgetful:
        """Loses markers the first time, keeps them when told so."""

        def translate(self, items, lang, hint, problem):
            keep = problem and "lost" in problem
            return json.dumps({"translations": [{"chunkId": i, "translatedText": f"<{lang}> " + (t if keep else t.replace("⟦CODE0⟧", "code"))} for i, t in items]})

    return Forgetful


def test_two_runs_and_self_healing(spark):
    corpus = spark.createDataFrame([("docs/a.md", "# One\n\nUse `x` now.\n\nAgain.\n\nAgain.\n"), ("docs/b.md", "Other API text.\n"), ("docs/gen.md", q.HEADER_PREFIX + " x -->\n\ntext")], "path string, body string")
    base = spark.createDataFrame([], "path string, source_hash string")
    terms = spark.createDataFrame([(1, "dont_translate", None, "API", None, True)], TERMS)
    first = engine.run(corpus, base, ["tr", "de"], spark.createDataFrame([], EMPTY), terms, make=forgetful())
    assert {r.target_lang: (r.chunks_translated, r.chunks_from_cache) for r in first.languages.collect()} == {"tr": (5, 0), "de": (5, 0)}
    outputs = {r.output_path: r.markdown for r in first.outputs.collect()}
    assert set(outputs) == {"docs/tr/a.md", "docs/tr/b.md", "docs/de/a.md", "docs/de/b.md"}
    assert "<tr> Use `x` now." in outputs["docs/tr/a.md"] and outputs["docs/tr/a.md"].startswith(q.HEADER_PREFIX)
    assert first.events.where("category = 'healed'").count() == 2
    remembered = spark.createDataFrame(first.memory.collect(), EMPTY)
    second = engine.run(corpus, base, ["tr", "de"], remembered, terms, make=forgetful())
    assert {r.target_lang: (r.chunks_translated, r.chunks_from_cache) for r in second.languages.collect()} == {"tr": (5, 5), "de": (5, 5)}
    assert memory.misses(second.translations.select("path", "target_lang", "content_hash"), remembered).count() == 0


CODE = "```\ncode\n```\n\n---\n"


def test_pages_without_chunks_and_without_answers(spark):
    class Deaf:
        """Answers nothing about one page in one language."""

        def translate(self, items, lang, hint, problem):
            if lang == "de" and any("Deaf" in t for _, t in items):
                return "no"
            return json.dumps({"translations": [{"chunkId": i, "translatedText": f"<{lang}> {t}"} for i, t in items]})

    corpus = spark.createDataFrame([("docs/code.md", CODE), ("docs/empty.md", ""), ("docs/text.md", "Text.\n"), ("docs/deaf.md", "Deaf.\n"), ("docs/null.md", None)], "path string, body string")
    base = spark.createDataFrame([], "path string, source_hash string")
    result = engine.run(corpus, base, ["tr", "de"], spark.createDataFrame([], EMPTY), spark.createDataFrame([], TERMS), make=lambda: Deaf())
    outputs = {r.output_path: r.markdown for r in result.outputs.collect()}
    assert set(outputs) == {f"docs/{lang}/{name}.md" for lang in ("tr", "de") for name in ("code", "empty", "text")} | {"docs/tr/deaf.md"}
    for lang in ("tr", "de"):
        assert outputs[f"docs/{lang}/code.md"].startswith(q.HEADER_PREFIX) and outputs[f"docs/{lang}/code.md"].endswith("-->\n\n" + CODE)
        assert outputs[f"docs/{lang}/empty.md"].startswith(q.HEADER_PREFIX) and outputs[f"docs/{lang}/empty.md"].endswith("-->\n\n")
    assert [r.path for r in result.documents.where("error is not null").collect()] == ["docs/deaf.md"]
    assert result.events.where("category = 'skipped' and path = 'docs/deaf.md' and target_lang = 'de'").count() == 1
    assert {r.target_lang: r.chunks_translated for r in result.languages.collect()} == {"tr": 2, "de": 1}


def test_failed_batch_leaves_no_half_written_page(spark):
    """One batch of a page fails in one language: no output there, an event with its path, and only that batch is asked for again."""

    class Picky:
        def __init__(self, deaf):
            self.deaf = deaf

        def translate(self, items, lang, hint, problem):
            if self.deaf and lang == "de" and any("second" in t for _, t in items):
                return "no"
            return json.dumps({"translations": [{"chunkId": i, "translatedText": f"<{lang}> {t}"} for i, t in items]})

    corpus = spark.createDataFrame([("docs/a.md", "The first text.\n\nThe second text.\n", "raw-a"), ("docs/b.md", "Other text.\n", "raw-b"), ("other/c.md", "No.\n", "raw-c")], "path string, body string, source_hash string")
    base, terms = spark.createDataFrame([], "path string, source_hash string"), spark.createDataFrame([], TERMS)
    first = engine.run(corpus, base, ["tr", "de"], spark.createDataFrame([], EMPTY), terms, make=lambda: Picky(True), budget=4, include="**/*.md")
    outputs = {r.output_path: r.markdown for r in first.outputs.collect()}
    assert set(outputs) == {"docs/tr/a.md", "docs/tr/b.md", "docs/de/b.md"}
    assert all(f"source-hash=raw-{k[-4]};" in v for k, v in outputs.items())
    (event,) = first.events.where("category = 'skipped'").collect()
    assert (event.path, event.target_lang) == ("docs/a.md", "de") and "1 of 2 chunks" in event.message
    assert {r.target_lang: r.chunks_translated for r in first.languages.collect()} == {"tr": 3, "de": 1}
    remembered = spark.createDataFrame(first.memory.collect(), EMPTY)
    assert remembered.count() == 5
    tree = spark.createDataFrame([(k, v) for k, v in outputs.items()], "path string, body string")
    second = engine.run(corpus.withColumn("source_hash", F.concat("source_hash", F.lit("2"))), base, ["tr", "de"], remembered, terms, make=lambda: Picky(False), budget=4, include="**/*.md", existing=tree)
    calls = second.translations.where("not from_cache").select("path", "target_lang", "source_text").collect()
    assert [tuple(r) for r in calls] == [("docs/a.md", "de", "The second text.")]
    assert set(r.output_path for r in second.outputs.collect()) == {f"docs/{x}.md" for x in ("tr/a", "tr/b", "de/a", "de/b")}
    assert sorted(r.message for r in second.events.where("category = 'stale'").collect()) == sorted(f"{k} [{k[5:7]}]: Source file changed since this translation was generated." for k in outputs)


def test_remembered_text_without_its_markers_is_repaired(spark):
    corpus = spark.createDataFrame([("docs/a.md", "Use `x` now.\n\nAgain `y`.\n")], "path string, body string")
    base, terms = spark.createDataFrame([], "path string, source_hash string"), spark.createDataFrame([], TERMS)
    first = engine.run(corpus, base, ["tr"], spark.createDataFrame([], EMPTY), terms)
    bad = first.memory.select("path", "target_lang", "content_hash", F.when(F.col("translated_text").startswith("[tr] Use"), "[tr] Use code").otherwise(F.col("translated_text")).alias("translated_text"))
    second = engine.run(corpus, base, ["tr"], spark.createDataFrame(bad.collect(), EMPTY), terms)
    assert second.outputs.first().markdown.endswith("[tr] Use `x` now.\n\n[tr] Again `y`.\n")
    assert second.events.where("category = 'healed'").count() == 1 and second.languages.first().chunks_from_cache == 2
    assert {r.translated_text for r in second.memory.collect()} == {r.translated_text for r in first.memory.collect()}


def test_stale_outputs_are_found_without_translating(spark, data, monkeypatch):
    """The audit needs hashes and headers: no page is parsed, nothing is asked for, and no text is shuffled."""
    monkeypatch.setattr(q.chunk_ops, "extract", None)
    monkeypatch.setattr(translate, "run", None)
    found = q.pipeline_stale(spark, data)
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan
    assert all("text#" not in line or "sha2" in line for line in plan.splitlines() if "Exchange" in line)


def test_counts_alone_look_up_no_clashing_outputs(spark, data, monkeypatch):
    """what pipeline_summary doesn't ask for isn't run for it."""
    monkeypatch.setattr(paths, "outputs_once", None)
    assert {r.target_lang for r in q.pipeline_summary(spark, data).collect()} == set(q.LANGS)


def test_calls_that_do_not_wait_need_no_threads():
    """only a class that says so of itself; others keep several calls in flight."""

    class Slow(translate.FakeTranslator):
        pass

    assert not translate.waits(translate.FakeTranslator()) and translate.waits(Slow()) and translate.waits(providers.HttpTranslator.__new__(providers.HttpTranslator))


def test_a_text_is_scanned_once_for_all_its_checks(monkeypatch):
    """the answer's check and its splicing read the same scan."""
    from quillstream.functions import markers

    scans, read = [], markers._MARK
    monkeypatch.setattr(markers, "_MARK", type("Counted", (), {"split": lambda self, text: scans.append(text) or read.split(text)})())
    source, answer = "F3 use ⟦CODE0⟧ <em0>now</em0>.", "[tr] F3 use ⟦CODE0⟧ <em0>now</em0>."
    assert markers.keeps(source, answer)
    assert markers.splice(answer, {0: "`x`"}, {}, {0: {"delim": "*", "count": 1}}) == "[tr] F3 use `x` *now*."
    assert scans == [source, answer]


def test_texts_are_not_kept_once_a_language(spark):
    """What the whole flow leaves in the shared folder stays below the pages themselves, though it has seven languages."""
    words = ["".join(chr(97 + b % 26) for b in hashlib.sha256(str(n).encode()).digest()[:7]) for n in range(20_000)]
    bodies = [(f"docs/p{n}.md", "\n\n".join(" ".join(words[(n * 977 + k * 31 + j) % 20_000] for j in range(40)) for k in range(30)) + "\n") for n in range(60)]
    corpus, base = spark.createDataFrame(bodies, "path string, body string"), spark.createDataFrame([], "path string, source_hash string")
    remembered = spark.createDataFrame([("docs/p1.md", lang, hashlib.sha256(bodies[1][1].split("\n\n")[0].encode()).hexdigest(), "Known.") for lang in q.LANGS], EMPTY)
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files_ in os.walk(root) for f in files_)
    before = size()
    result = engine.run(corpus, base, q.LANGS, remembered, spark.createDataFrame([], TERMS))
    assert result.outputs.count() == 60 * 7 and {(r.chunks_translated, r.chunks_from_cache) for r in result.languages.collect()} == {(1800, 1)}
    assert size() - before < 4 * sum(len(b) for _, b in bodies)


def test_summary_reads_no_texts(spark, data):
    """The counts by language come from flags alone, out of what the flow has written in columns."""
    plan = q.pipeline_summary(spark, data)._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert read and all("from_cache" in line and "markdown" not in line and "source_text" not in line for line in read)


def test_outputs_of_one_path(spark, monkeypatch):
    rows = [("docs/a", "de", "x", "1"), ("docs/b", "de", "x", "2"), ("docs/b", "fr", "x", "0"), ("docs/c", "de", "y", "3"), ("docs/d", "de", None, "4")]
    frame = spark.createDataFrame(rows, "path string, target_lang string, output_path string, markdown string")
    args = ("output_path", ["path", "target_lang"], "markdown")
    want = {tuple(r) for r in paths.last_write_wins(frame, *args).collect()}
    assert want == {("x", "0", 3), ("y", "3", 1), (None, "4", 1)}
    for most in (100, 0):  # few paths that are written twice, and too many to send to all
        monkeypatch.setattr(paths, "BROADCAST_CLASHES", most)
        assert {tuple(r) for r in paths.outputs_once(frame, *args).collect()} == want


def test_ids_of_a_reply():
    assert translate.id_problem(["a", "b", "a"], ["b", "c", "c", "b"]) == "Chunk id mismatch in provider response (missing: a; unexpected: c; duplicated: b, c)."
    assert translate.id_problem(["a", "b"], ["b", "a"]) is None


@pytest.mark.parametrize("name", ["md_identity_roundtrip", "md_translated"])
def test_page_queries_keep_pages_without_chunks(spark, tmp_path, name):
    spark.createDataFrame([(1, CODE), (2, ""), (3, "Text.\n")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text_hash, r.error) for r in q.QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1] == (hashlib.sha256(CODE.encode()).hexdigest(), None) and got[2] == (hashlib.sha256(b"").hexdigest(), None)


def test_files(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "docs" / "x").mkdir(parents=True)
    (root / "docs" / "a.md").write_bytes("﻿# A\n".encode())
    (root / "docs" / "x" / "b.md").write_text("b")
    (root / "docs" / "c.txt").write_text("c")
    got = {r.path: r.body for r in files.documents(spark, str(root)).collect()}
    assert got == {"docs/a.md": "# A\n", "docs/x/b.md": "b"}
    (root / ".ignore").write_text("# c\n\n  DRAFT_*.md \n")
    assert files.ignore_patterns(str(root / ".ignore")) == ["DRAFT_*.md"] and files.ignore_patterns(str(root / "none")) == []
    assert files.glossary_frame(spark, str(root / "none")).first()[0] == "{}"
    out = spark.createDataFrame([("a/b.md", "x"), ("c.md", "y")], "path string, markdown string")
    assert files.write_outputs(out, str(tmp_path / "out")) == 2 and (tmp_path / "out/a/b.md").read_text() == "x"
    with pytest.raises(Exception, match="leaves its root"):
        files.write_outputs(spark.createDataFrame([("../x", "y")], "path string, markdown string"), str(tmp_path / "out"))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_memory_versions(spark, tmp_path, scheme):
    store = f"{scheme}{tmp_path}/memory"
    assert files.read_memory(spark, store).count() == 0
    new = spark.createDataFrame([("p", "tr", "h", "t", 1)], EMPTY + ", seq int")
    assert files.write_memory(files.read_memory(spark, store), store, new, "seq") == 1
    before = files.read_memory(spark, store)
    for n in range(2, 6):
        assert files.write_memory(files.read_memory(spark, store), store, new.withColumn("translated_text", F.lit(f"u{n}")), "seq") == n
    assert [tuple(r) for r in files.read_memory(spark, store).select("path", "translated_text").collect()] == [("p", "u5")]
    assert sorted(storage.versions(spark, store)) == [3, 4, 5] and before.columns == ["path", "target_lang", "content_hash", "translated_text"]
    # a version whose writing died doesn't count and goes with the next write
    (tmp_path / "memory" / "v-0000000006").mkdir()
    assert files.read_memory(spark, store).first().translated_text == "u5"
    assert files.write_memory(files.read_memory(spark, store), store, new, "seq") == 7 and 6 not in storage.versions(spark, store)
    for version in (tmp_path / "memory").iterdir():
        if version.is_dir():
            (version / "_SUCCESS").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="whole"):
        files.read_memory(spark, store)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.parquet").write_text("")
    with pytest.raises(ValueError, match="no versioned table"):
        files.read_memory(spark, f"{scheme}{tmp_path}/other")


def test_paths_with_odd_names(spark, tmp_path):
    root = tmp_path / "it's" / "docs"
    (root / "docs").mkdir(parents=True)
    (root / "docs" / "ä b%20.md").write_text("x")
    assert [r.path for r in files.documents(spark, f"file://{root}").collect()] == ["docs/ä b%20.md"]


def test_publishing_again_changes_nothing(spark, tmp_path):
    outputs = spark.createDataFrame([("tr/a.md", "A\n"), ("tr/b.md", "B\n")], "output_path string, markdown string")
    asked = publish.request_of("o/r", "abc1234", "first")
    assert (asked.branch, asked.base) == ("translations/abc1234", "main") and publish.request_of("o/r", "x", "", "dev").base == "dev"
    table = publish.TablePublisher(str(tmp_path / "published"))
    one, two = table.publish(outputs, asked), table.publish(outputs.limit(1), publish.request_of("o/r", "abc1234", " "))
    assert (one.number, one.created, one.files) == (1, True, 2) and (two.number, two.created, two.files) == (1, False, 1)
    assert table.publish(outputs, publish.request_of("o/r", "def", "")).number == 2
    table.close(spark, 1)
    assert table.publish(outputs, asked).number == 3
    assert {r.number: (r.open, r.comments) for r in table.requests(spark).collect()} == {1: (False, ["first"]), 2: (True, []), 3: (True, ["first"])}
    assert publish.FolderPublisher(str(tmp_path / "dry")).publish(outputs).files == 2 and (tmp_path / "dry/tr/b.md").read_text() == "B\n"

    git = lambda where, *a: subprocess.run(["git", "-C", str(where), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True, text=True).stdout
    (tmp_path / "remote").mkdir(), (tmp_path / "copy").mkdir()
    git(tmp_path / "remote", "init", "-q", "--bare")
    git(tmp_path / "copy", "init", "-q")
    (tmp_path / "copy" / "README").write_text("x")
    git(tmp_path / "copy", "add", "."), git(tmp_path / "copy", "commit", "-q", "-m", "start"), git(tmp_path / "copy", "remote", "add", "origin", str(tmp_path / "remote"))
    opened = []
    host = publish.GitPublisher(str(tmp_path / "copy"), open_request=lambda r: (opened.append(r.branch) or "http://x/1", 1, len(opened) == 1))
    assert [host.publish(outputs, asked).created for _ in range(2)] == [True, False]
    assert git(tmp_path / "remote", "show", f"{asked.branch}:tr/a.md") == "A\n" and len(git(tmp_path / "remote", "log", "--oneline", asked.branch).splitlines()) == 2
    with pytest.raises(ValueError, match="leaves its root"):
        host.publish(spark.createDataFrame([("../x", "y")], "output_path string, markdown string"), asked)


def test_http_translator():
    seen = []

    class Host(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], body))
            busy = len(seen) == 1
            self.send_response(429 if busy else 200)
            self.send_header("Retry-After", "0")
            self.end_headers()
            text = json.dumps({"translations": [{"chunkId": "a", "translatedText": "Bir"}]})
            self.wfile.write(json.dumps({"choices": [{"message": {"content": text}}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Host)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    providers.register_all({"local": (f"http://127.0.0.1:{server.server_port}/v1", "LOCAL_KEY", "LOCAL_MODEL", "small")})
    env = options.published(options.resolve({"provider": "local"}), {"LOCAL_KEY": "k", "LOCAL_MODEL": " "})
    assert env == {"LOCAL_KEY": "k", "INPUT_LLM_PROVIDER": "local", "INPUT_MAX_PARALLEL_REQUESTS": "4"}
    own = translate.select(env, env["INPUT_LLM_PROVIDER"])
    assert translate.translate_batch(own, [("a", "One")], "tr", "Hint.", translate.Retry(), lambda s: None) == ({"a": "Bir"}, None)
    assert len(seen) == 2 and seen[1][0] == "Bearer k" and seen[1][1]["model"] == "small"
    assert "Hint." in seen[1][1]["messages"][0]["content"] and seen[1][1]["messages"][1]["content"].endswith("[a]: One\n")
    server.shutdown()
    with pytest.raises(translate.CallError):
        providers.HttpTranslator("http://127.0.0.1:9/", "k", "m", 1).translate([("a", "x")], "tr")
    translate.PROVIDERS.pop("local"), translate.KEYS.pop("LOCAL_KEY", None), translate.KEYS.pop("local", None)


def test_options(tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"targetLanguages": "fr,es", "maxParallel": 9, "sourcePath": "src", "failOnStaleTranslations": True}))
    o = options.resolve({"source_path": "cli"}, {"INPUT_SOURCE-PATH": "env", "INPUT_BASE_BRANCH": " ", "INPUT_MAX-PARALLEL": "junk"}, str(config))
    assert (o.source_path, o.target_languages, o.max_parallel, o.base_branch, o.fail_on_stale_translations) == ("cli", ("fr", "es"), 4, None, True)
    assert options.resolve({}, {"INPUT_SOURCE_PATH": "env"}).source_path == "env"
    assert options.resolve({"pr_mode": "false"}).dry_run and not options.resolve({"dry_run": "true"}).pr_mode
    with pytest.raises(ValueError):
        options.resolve({"dry_run": "maybe"})
    with pytest.raises(FileNotFoundError):
        options.resolve(config_path=str(tmp_path / "none"))
    assert options.repository("o/r/x") == ("o", "r/x")
    with pytest.raises(ValueError):
        options.repository("none")


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "# A\n\ntext"), ("b", "x")], "path string, body string").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):  # the second start finds nothing new
        ingest.chunk_stream(ingest.arriving(spark, str(tmp_path / "in"), "path string, body string"), "path", "body", out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", list(q.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for file in os.listdir(data):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{data}/{file}'")
    want = con.sql(q.oracle_sql()[name])
    got = q.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted((tuple(map(plain, r)) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.oracle_sql()])
def test_other_queries_run(spark, data, name):
    assert q.QUERIES[name](spark, data).count() > 0
