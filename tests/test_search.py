"""Searches in rounds against a server of one's own, and what reviewers' decisions change."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from verbena.operators import search
from verbena.service import Collection

PAGES = {
    "/about": "<html><title>The Thonin language</title><body><p>Thonin is also known as Hakhunda. The Thonin language has around 4,500 speakers. <a href='/files/thonin_words.txt'>Thonin wordlist</a> <a href='/secret/x'>Thonin secret</a></p></body></html>",
    "/plain": "<html><title>Songs of the hills</title><body><p>The singers call themselves Hakhunda.</p></body></html>",
    "/later": "<html><title>Hakhunda songs</title><body><p>Hakhunda people sing. <a href='/files/hakhunda_songs.txt'>Hakhunda songs</a></p></body></html>",
    "/other": "<html><title>Cooking</title><body><p>Nothing of the kind.</p></body></html>",
    "/secret/x": "<html><title>Thonin Thonin</title><body>Thonin</body></html>",
    "/files/thonin_words.txt": "ami water, ata fire",
    "/files/hakhunda_songs.txt": "one song and another",
    "/robots.txt": "User-agent: *\nDisallow: /secret/",
}
ASKED: list[str] = []


class Web(BaseHTTPRequestHandler):
    def do_GET(self):
        at = urlsplit(self.path)
        if at.path == "/search":
            q = parse_qs(at.query)["q"][0]
            ASKED.append(q)
            hits = ["/later", "/plain"] if "Hakhunda" in q else ["/about", "/plain", "/other"] if q == '"Thonin" language' else []
            body, kind = json.dumps({"results": [{"url": f"http://{self.headers['Host']}{h}", "title": h} for h in hits]}), "application/json"
        elif at.path == "/api":
            q = parse_qs(at.query)
            host = f"http://{self.headers['Host']}"
            pages = {
                "1": [{"t": "Thonin wordlist", "lang": "qqx", "link": f"{host}/r/1", "kinds": ["wordlist"], "data": [{"u": f"{host}/files/thonin_words.txt", "s": "19"}, {"u": f"{host}/files/huge.bin", "s": "900000000"}]}, {"t": "Cooking", "link": f"{host}/r/2", "data": []}],
                "2": [{"t": "Thonin grammar", "link": f"{host}/r/3", "kinds": ["grammar"], "data": []}, {"t": "A Thonin", "link": f"{host}/r/1"}, {"t": "Tales", "lang": "x", "kinds": ["grammar", "Thonin texts"], "link": f"{host}/r/4", "data": [{"u": f"{host}/files/hakhunda_songs.txt"}, {"u": f"{host}/files/gone.txt"}]}],
            }
            body, kind = json.dumps({"hits": {"items": pages.get(q["page"][0], []) if "language" in q["q"][0] else []}}), "application/json"
        elif at.path in PAGES:
            body, kind = PAGES[at.path], "text/html" if PAGES[at.path].startswith("<html") else "text/plain"
        else:
            self.send_error(404)
            return
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Web)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_search_learns_downloads_and_proposes(spark, site, tmp_path):
    c = Collection(spark, str(tmp_path))
    language = c.open_language("Thonin", "qqx")
    ask = search.engines([{"name": "own", "kind": "json", "url": f"{site}/search?q={{query}}"}], "Thonin", "qqx")
    limits = search.SearchLimits(per_host=10)
    out = {r.path.rpartition("/")[2]: r for r in c.search(language, ask, limits=limits).collect()}
    # the first round finds a file of its own; the second, by a name that the first taught, another one
    assert {"thonin_words.txt", "hakhunda_songs.txt"} <= set(out)
    assert any("Hakhunda" in q for q in ASKED) and len(ASKED) == len(set(ASKED))
    assert [r.value for r in c.table("taught").collect()] == ["Hakhunda"]
    told = {json.loads(r.payload)["field"]: r for r in c.reviews().where("kind = 'profile_field'").collect()}
    assert set(told) >= {"alternate_names", "speakers"}
    session = c.sessions().first()
    assert (session.status, session.mode) == ("finished", "agent")
    assert not any("secret" in (r.url or "") for r in c.table("find").collect())

    # decisions act: a proposal counts once it is accepted, and no more when it is rejected later
    terms = lambda: [r.term for r in c._terms().where("signal = 'alternate_name'").collect()]
    assert terms() == []
    c.decide(told["alternate_names"].item_id, "accepted")
    assert terms() == ["Hakhunda"]
    c.decide(told["alternate_names"].item_id, "skipped")
    assert terms() == ["Hakhunda"]
    c.decide(told["alternate_names"].item_id, "rejected")
    assert terms() == []
    assert {r.item_id: r.status for r in c.reviews().collect()}[told["alternate_names"].item_id] == "rejected"
    # what was rejected is not proposed as new by the same pages' values, and nothing is stored by a pass that only learns
    before = c.resources().count()
    c.enrich(language, ask)
    assert c.resources().count() == before


def test_catalogues_are_asked_scored_and_taken_in(spark, site, tmp_path):
    c = Collection(spark, str(tmp_path))
    language = c.open_language("Thonin", "qqx")
    fields = {"title": "t", "language": "lang", "url": "link", "types": "kinds", "files": "data", "file_url": "u", "file_size": "s"}
    entries = [
        {"name": "api", "mode": "api_json", "url": f"{site}/api?q={{query}}&page={{page}}", "pages": 2, "items": "hits.items[]", "fields": fields},
        {"name": "by_hand", "mode": "lookup", "url": f"{site}/look?q={{name}}"}, {"name": "down", "mode": "html_links", "url": f"{site}/none?q={{query}}"}, {"name": "coded", "needs_code": True, "mode": "lookup", "url": f"{site}/c/{{code}}"},
    ]
    out = {r.path.rpartition("/")[2]: r for r in c.search_catalogues(language, entries).collect()}
    # the file of a good record, a record for one without files; what is too large, irrelevant or a repeated result is not there
    assert {"thonin_words.txt", "thonin-grammar.metadata.json"} <= set(out) and not {"huge.bin", "cooking.metadata.json", "a-thonin.metadata.json"} & set(out)
    assert out["thonin_words.txt"].status in ("stored", "uncertain_review")
    events = {r.level: r.message for r in c.table("event").collect()}
    assert {x["provider"] for x in json.loads(events["lookups"])} == {"by_hand", "coded"}
    assert "lookups: 2" in events["info"] and "failed: 0" not in events["info"]
    assert c.sessions().first().status == "finished"


def test_rejected_resources_are_listed_no_more(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "thonin_a.txt").write_text("some words of it")
    (folder / "b.txt").write_text("other words")
    c = Collection(spark, str(tmp_path / "c"), confirmed_at=101)
    language = c.open_language("Thonin", "qqx")
    c.import_folder(str(folder), language)
    items = c.reviews().where("kind = 'resource'").collect()
    held = c.listing(language).collect()
    assert len(held) == 2 and {r.status for r in held} == {"uncertain"}
    if items:
        c.decide(items[0].item_id, "rejected")
        assert len(c.listing(language).collect()) == 1
        c.decide(items[0].item_id, "accepted")
        assert sorted(r.status for r in c.listing(language).collect()) == ["confirmed", "uncertain"]


def test_names_learned_in_the_last_round_count(spark):
    """Scores of pages visited before rise with a name that a later page teaches; limits bound what is learned."""
    rows = [("http://a.example/1", "Thonin", "Thonin and more", "Alphaname"), ("http://a.example/2", "Alphaname tales", "Alphaname", None)]
    web_ = spark.createDataFrame([(u, t, x) for u, t, x, _ in rows], "url string, title string, text string").selectExpr("*", "array(named_struct('url', '', 'anchor', '')) AS links")
    teach = spark.createDataFrame([(u, n) for u, _, _, n in rows if n], "url string, value string")
    queries = spark.createDataFrame([("q", "name", 1)], "query string, basis string, rank int")
    hits = lambda asked: asked.join(web_.selectExpr("url", "title", "1 AS n"), how="cross").select("query_id", "n", "url", "title")
    learn = lambda about: about.join(web_.select("url"), about["key"].contains(web_["url"].substr(8, 100))).join(teach, "url").selectExpr("key", "'identity' AS grp", "'alternate_names' AS field", "value", "0.5D AS confidence", "'' AS quote")
    languages = spark.createDataFrame([("l", "qqx", "Thonin")], "language_id string, iso string, name string")
    terms = spark.createDataFrame([], "language_id string, signal string, seq int, term string, weak boolean")
    fetch = lambda asked: asked.join(web_, "url")
    f = search.search_rounds(queries, hits, fetch, languages, terms, learn=learn, limits=search.SearchLimits(depth=1, rounds=1))
    scores = {r.key.rpartition("/")[2]: r.score for r in f.last_scores().collect()}
    first = {r.key.rpartition("/")[2]: r.score for r in f.scores.where("round = 1").collect()}
    assert first == {"1": 100, "2": 0} and scores == {"1": 100, "2": 85}
    none = search.search_rounds(queries, hits, fetch, languages, terms, learn=learn, limits=search.SearchLimits(depth=1, rounds=1, names=0))
    assert none.learned.count() == 0
