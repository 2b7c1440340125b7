"""A collection from import to review, on a sample folder, its sessions and archives, agents, jobs, and the command line."""

import io
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from verbena import agents, config
from verbena.progress import Jobs, Progress
from verbena.sources.sinks import Layout

from verbena import cli
from verbena.service import Collection


@pytest.fixture
def sample(tmp_path):
    d = tmp_path / "home" / "tangsa_stuff"
    d.mkdir(parents=True)
    (d / "Mossang_wordlist.txt").write_text("a wordlist\n")
    (d / "Tangsa_grammar_sketch.txt").write_text("grammar text\n")
    (d / "dup_copy.txt").write_text("grammar text\n")
    (d / "notes.eaf").write_text('<x LANG_REF="nst"><ANNOTATION_VALUE>nga tangsa</ANNOTATION_VALUE></x>')
    (tmp_path / "home" / "recipes.txt").write_text("unrelated\n")
    return tmp_path


def test_scan_links_copies_and_leaves_the_rest(spark, sample):
    c = Collection(spark, f"{sample}/root")
    language = c.open_language("Tangsa", "nst")
    assert language == "nst" and c.open_language("Tangsa", "nst") == "nst" and c.languages().count() == 1
    c.set_value("nst", "orthography_location", "varieties", '["Mossang"]')
    out = {r.path.rsplit("/", 1)[1]: r.status for r in c.scan_folder(f"{sample}/home", "nst").collect()}
    assert "recipes.txt" not in out and sorted(out) == ["Mossang_wordlist.txt", "Tangsa_grammar_sketch.txt", "dup_copy.txt", "notes.eaf"]
    assert sorted(out.values()).count("duplicate_linked") == 1 and out["Mossang_wordlist.txt"] in ("stored", "uncertain_review")
    assert c.resources().count() == 3 and c.table("find").count() == 4
    again = {r.status for r in c.scan_folder(f"{sample}/home", "nst").collect()}
    assert again == {"duplicate_linked"} and c.resources().count() == 3 and c.table("find").count() == 8
    s = [(r.session_id[-3:], r.discovered, r.duplicates) for r in c.sessions().collect()]
    assert s == [("002", 4, 4), ("001", 4, 1)]
    assert c.home()["resources"] == 3 and c.profile_json().count() == 1


def test_import_is_asserted_and_reviews_are_decided(spark, sample):
    c = Collection(spark, f"{sample}/root2")
    c.open_language("Tangsa", "nst")
    out = c.import_folder(f"{sample}/home", "nst").collect()
    assert len(out) == 5 and {r.score for r in out} == {100}
    d = Collection(spark, f"{sample}/root3", confirmed_at=101)
    d.open_language("Tangsa", "nst")
    d.import_folder(f"{sample}/home", "nst")
    pending = d.reviews().where("status = 'pending'").collect()
    assert len(pending) == 4 and d.review_summary().first().resources == 4
    d.decide(pending[0].item_id, "accepted")
    assert d.reviews().where("status = 'accepted'").count() == 1 and d.review_summary().first().resources == 3


def test_sessions_end_in_a_state(spark, sample):
    c = Collection(spark, f"{sample}/root5")
    c.open_language("Tangsa", "nst")
    a, b = c.open_session("nst", "agent"), c.open_session("nst", "agent")
    assert a[-3:] == "001" and b[-3:] == "002" and c.unfinished().count() == 2
    c.finish(a)
    heard = []
    c.on_outcome, c.on_message = lambda rows: heard.append(rows.count()), heard.append
    broken = spark.createDataFrame([("p",)], "path string").withColumn("content", F.raise_error(F.lit("gone")).cast("binary")).withColumn("method", F.lit("import"))
    with pytest.raises(Exception, match="gone"):
        c.take_in(broken, "nst", "import")
    assert {r.session_id[-3:]: r.status for r in c.sessions().collect()} == {"001": "finished", "002": "running", "003": "failed"}
    assert [h for h in heard if isinstance(h, str)] and c.table("event").count() == 1
    c.import_folder(f"{sample}/home", "nst")
    row = c.sessions().where("session_id LIKE '%004'").first()
    assert (row.status, row.language, row.discovered) == ("finished", "Tangsa", 5) and heard[-1] == 5
    with pytest.raises(ValueError):
        c.open_session("nst", "magic")


def test_numbers_are_given_once(spark, sample):
    c = Collection(spark, f"{sample}/root6")
    got = []
    workers = [threading.Thread(target=lambda: got.append(c.open_session("nst", "import"))) for _ in range(6)]
    [w.start() for w in workers]
    [w.join() for w in workers]
    assert len(got) == 6 == len({*got})
    rows = c.table("session").select("seq").collect()
    assert len({r.seq for r in rows}) == 6


def test_members_of_archives_are_taken_in(spark, sample):
    def packed(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, x in files.items():
                z.writestr(n.replace("_dot_", "."), x)
        return out.getvalue()

    inner = packed(deep_dot_txt="a text deep down in the archive")
    (sample / "home" / "box.zip").write_bytes(packed(one_dot_txt="grammar text\n", two_dot_txt="something new", inner_dot_zip=inner))
    c = Collection(spark, f"{sample}/root7", open_archives=True)
    c.open_language("Tangsa", "nst")
    out = {r.path.rsplit("/", 1)[1]: r.status for r in c.import_folder(f"{sample}/home", "nst").collect()}
    assert out["box.zip"] == "stored" and out["box.zip!two.txt"] == "stored" and out["box.zip!one.txt"] == "duplicate_linked"
    assert out["box.zip!inner.zip"] == "stored" and out["box.zip!inner.zip!deep.txt"] == "stored"
    assert {r.text for r in c.table("text").collect()} >= {"something new", "a text deep down in the archive"}
    assert c.listing("nst").count() == c.resources().count()


def test_agents(spark, tmp_path):
    known = {"echo": {"command": "cat", "what": "says it again"}, "none": {"command": "no-such-tool {prompt}"}}
    assert agents.build({}).name == "rule_based" and agents.build({"provider": "echo"}, known).available() == (True, "")
    assert not agents.build({"provider": "none"}, known).available()[0] and agents.installed(known) == [("echo", True, "says it again"), ("none", False, "")]
    with pytest.raises(ValueError):
        agents.build({"provider": "other"}, known)
    agents.choose(f"{tmp_path}/c.toml", "echo", known)
    assert config.load(f"{tmp_path}/c.toml")["agent"]["provider"] == "echo"
    with pytest.raises(ValueError):
        agents.choose(f"{tmp_path}/c.toml", "other", known)
    assert agents.ask("cat", 'x {"a": 1}') == ('{"a": 1}', None) and agents.ask("no-such-tool", "x")[0] is None and agents.ask("cat", "no answer") == (None, "no JSON in the answer")
    assert agents.ask("sleep 5", "x", seconds=1)[1].startswith("TimeoutExpired")
    tool = agents.ToolAgent("fixed", """sh -c 'cat > /dev/null; echo "{\\"score\\": 90}"'""", agents.RuleAgent())
    c = spark.createDataFrame([(1, "nst", "nothing to see"), (2, "nst", "Tangsa grammar")], "candidate_id long, language_id string, text string")
    lang = spark.createDataFrame([("nst", "nst", "Tangsa")], "language_id string, iso string, name string")
    terms = spark.createDataFrame([], "language_id string, signal string, seq int, term string, weak boolean")
    rules = {r.candidate_id: r.score for r in agents.RuleAgent().analyse(c, lang, terms).collect()}
    moved = {r.candidate_id: r.score for r in tool.analyse(c, lang, terms).collect()}
    assert rules[1] == 0 and moved == {1: 25, 2: min(90, rules[2] + 25)}
    asked = spark.createDataFrame([("nst", "Tangsa", "name", None, 0)], "language_id string, name string, kind string, term string, seq int")
    more = agents.ToolAgent("q", """sh -c 'cat > /dev/null; echo "[{\\"query\\": \\"Tase songs\\"}, {\\"query\\": \\"\\"}]"'""", agents.RuleAgent()).queries(asked)
    assert [r.query for r in more.where("basis = 'agent:q'").collect()] == ["Tase songs"] and more.where("basis = 'name'").count() == 6


def test_progress_and_jobs():
    now, heard = [0.0], []
    p = Progress(heard.append, interval=1.0, clock=lambda: now[0])
    p.step(stage="a")
    p.step(record=1)
    p.start("k", "f.pdf", 10)
    assert len(heard) == 1
    now[0] = 2.0
    p.moved("k", 5)
    p.step(stage="b")
    p.done("k", ok=False, message="lost")
    assert len(heard) == 4 and heard[-1]["transfers"]["k"] == {"name": "f.pdf", "size": 10, "done": 5, "status": "failed", "message": "lost"} and heard[-1]["record"] == 1
    jobs, go = Jobs(), threading.Event()

    def work(job):
        job.say("began")
        go.wait(5)
        return "cancelled" if job.cancelled() else 42

    first, second = jobs.start("one", work), jobs.start("two", lambda job: 1 / 0)
    assert jobs.wait(second).status == "failed" and "ZeroDivisionError" in jobs.poll(second)["error"]
    assert jobs.poll(first)["status"] == "running"
    jobs.cancel(first)
    go.set()
    assert jobs.wait(first).result == "cancelled" and jobs.poll(first, since=1)["messages"] == [] and [j["status"] for j in jobs.list()] == ["cancelled", "failed"]


def test_folders_and_registries(tmp_path):
    layout = Layout(str(tmp_path))
    layout.ensure("nst")
    assert (tmp_path / "languages/nst/resources/audio").is_dir() and (tmp_path / "search-engines").is_dir() and layout.of("nst", "metadata").endswith("languages/nst/metadata")
    for bad in (lambda: layout.shared("x"), lambda: layout.of("nst", category="x")):
        with pytest.raises(ValueError):
            bad()
    path = f"{tmp_path}/e.toml"
    config.add_entry(path, "engine", {"name": "own", "kind": "json", "url": "http://x"})
    with pytest.raises(ValueError):
        config.add_entry(path, "engine", {"name": "bad", "kind": "soap"})
    assert config.entries_of(path, "engine") == [{"name": "own", "kind": "json", "url": "http://x"}]
    assert config.remove_entry(path, "engine", "own") and not config.remove_entry(path, "engine", "own") and config.entries_of(path, "engine") == []


def test_command_line(spark, sample, capsys):
    root = f"{sample}/root4"
    assert cli.main(["--root", root, "languages"]) == 10
    assert cli.main(["--root", root, "import", "Tangsa", f"{sample}/home", "--iso", "nst"]) == 0
    assert cli.main(["--root", root, "history"]) == 0 and "COL-" in capsys.readouterr().out
    assert cli.main(["--root", root, "status"]) == 0 and "resources\t4" in capsys.readouterr().out
    assert cli.main(["--root", root, "nonsense"]) == 20
    assert cli.main(["--root", root, "import", "X", f"{sample}/missing"]) == 40


def test_command_line_for_settings(tmp_path, capsys):
    run = lambda *a: cli.main(["--root", f"{tmp_path}/r", *a])
    assert run("registry", "engine", "list") == 10
    assert run("registry", "engine", "add", "name=own", "kind=json", "url=http://x?q={q}") == 0 and run("registry", "engine", "add", "name=bad", "kind=soap") == 40
    assert run("registry", "engine", "list") == 0 and "own\tkind=json" in capsys.readouterr().out
    assert run("registry", "tool", "add", "name=echo", "command=cat") == 0 and run("registry", "tool", "add", "name=x") == 40
    assert run("agent", "echo") == 0 and run("agent", "other") == 40 and run("agent") == 0
    assert "*\techo\tinstalled" in capsys.readouterr().out
    assert run("registry", "engine", "remove", "name=own") == 0 and run("registry", "engine", "remove", "name=own") == 10


def test_a_tool_adds_types_and_facts(spark):
    def tool(answer):
        return agents.ToolAgent("t", "sh -c 'cat > /dev/null; echo \"" + answer.replace('"', '\\"') + "\"'", agents.RuleAgent())

    d = spark.createDataFrame([(1, "text", "text", "Tangsa grammar", None)], "resource_id int, format string, category string, words string, hints array<string>")
    rules = {r.type: r.confidence for r in agents.RuleAgent().classify(d).collect()}
    more = {r.type: r.confidence for r in tool('[{"type": "corpus", "confidence": 7}, {"type": "grammar", "confidence": 0.1}, {"type": "nonsense"}, {"type": "lexicon"}]').classify(d).collect()}
    assert more == rules | {"corpus": 1.0, "lexicon": 0.5} and more["grammar"] > 0.1
    t = spark.createDataFrame([(1, "Tangsa is spoken in Ledo.")], "k int, text string")
    answer = '[{"group": "identity", "field": "exonyms", "value": ["Aa", "Bb"], "quote": "q"}, {"group": "x", "field": "y", "value": "z"}, {"group": "identity", "field": "family", "value": "Fam", "confidence": 0.9}]'
    base = {(r.field, r.value) for r in agents.RuleAgent().facts(t, "k", "Tangsa").collect()}
    got = {(r.field, r.value, r.confidence) for r in tool(answer).facts(t, "k", "Tangsa").collect()}
    assert {x[:2] for x in got} == base | {("exonyms", "Aa"), ("exonyms", "Bb"), ("family", "Fam")} and ("family", "Fam", 0.9) in got and ("exonyms", "Aa", 0.5) in got
    broken = tool("no answer")
    assert {r.type for r in broken.classify(d).collect()} == set(rules) and {(r.field, r.value) for r in broken.facts(t, "k", "Tangsa").collect()} == base
