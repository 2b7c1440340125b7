"""Collections on disk: languages, profiles, resources, sessions and reviews as append-only tables under one root, and what can be asked of them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.functions import web
from verbena.functions.text import fold_string
from verbena.operators import discover, extract, ingest, neardup, online, profile, registry, search, state
from verbena.operators.sketchindex import SketchIndex
from verbena.session import ship, written
from verbena.sources import files, http, sinks

#: The tables and their columns; every one also has seq, which grows with each write and differs within it.
TABLES = {
    "language": "id string, name string, iso string, created_at timestamp",
    "value": "language_id string, grp string, field string, value_json string, source_type string, confidence double, recorded_at string, preferred boolean, status string",
    "outcome": "candidate_id string, session_id string, language_id string, path string, sha256 string, size int, status string, score int, band string, reasons array<string>, format string, category string, message string",
    "find": "sha256 string, language_id string, session_id string, method string, url string, original_path string",
    "text": "sha256 string, language_id string, text string, extractor string",
    "near": "resource_id string, other_id string, similarity double",
    "item": "item_id string, language_id string, session_id string, kind string, payload string, confidence double",
    "decision": "item_id string, decision string, decided_by string",
    "sketch": "sha256 string, language_id string, sketch array<string>, session_id string",
    "taught": "session_id string, language_id string, value string, signal string, source_ref string",
    "session": "session_id string, language_id string, mode string, status string, started_at timestamp",
    "event": "session_id string, level string, message string, at timestamp",
}
SEQ = "decimal(38,0)"
#: An archive in an archive in an archive is opened, one within that is not.
ARCHIVE_DEPTH = 3
#: Intakes that an index of sketches holds apart before they become one.
MOST_PARTS = 32
MODES = ("offline", "import", "catalogue", "agent", "import-member")


@dataclass
class Collection:
    spark: SparkSession
    root: str
    review_at: int = 30
    confirmed_at: int = 70
    near_at: float = 0.85
    open_archives: bool = False
    on_message: Callable[[str], None] | None = None
    on_outcome: Callable[[DataFrame], None] | None = None

    def __post_init__(self) -> None:
        ship(self.spark)

    # ------------------------------------------------------------ tables
    def _path(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def table(self, name: str) -> DataFrame:
        """All rows of a table so far; none before the first write."""
        path, files_ = self._path(name)
        schema = f"{TABLES[name]}, seq {SEQ}"
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{name}") if files_.exists(path) else self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame) -> str:
        """Add rows, and the folder that has them; their seq is the time of the write, then a number that no other row of the write has. Each write is a folder of its own, so
        that several may go on at once."""
        base = Decimal(int(datetime.now(UTC).timestamp() * 1_000_000) << 63)
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        number = F.monotonically_increasing_id().cast("decimal(20,0)")
        place = f"{self.root}/{name}/{uuid.uuid4().hex}"
        rows.select(*columns, (F.lit(base).cast(SEQ) + number).cast(SEQ).alias("seq")).write.parquet(place, compression="zstd")  # sketches are hex digits, half of which snappy leaves
        return place

    # ------------------------------------------------------------ languages and profiles
    def open_language(self, name: str, iso: str | None = None) -> str:
        """The id of a language, made if it is new: its code, or x- and a slug."""
        key = iso or "x-" + "-".join(fold_string(name).split())
        if self.languages().where(F.col("id") == key).isEmpty():
            self.append("language", self.spark.createDataFrame([(key, name, iso, datetime.now(UTC))], TABLES["language"]))
        return key

    def languages(self) -> DataFrame:
        return state.languages(self.table("language"))

    def resolve(self, query: str, index: DataFrame, known: DataFrame, retired: DataFrame | None = None) -> DataFrame:
        q = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        own = self.languages()
        names = own.select(F.col("id").alias("language_id"), F.explode(F.array(F.struct(F.lit("name").alias("check"), F.col("name").alias("text")), F.struct(F.lit("iso").alias("check"), F.col("iso").alias("text")))).alias("c")).select("language_id", "c.*").where("text IS NOT NULL")
        return registry.resolve(q, registry.find_local(q, names), registry.find(q, index, known, retired), own.select(F.col("id").alias("language_id"), F.col("iso").alias("code")))

    def set_value(self, language: str, grp: str, field: str, value_json: str, source: str = "user", confidence: float = 1.0, status: str = "accepted") -> None:
        row = (language, grp, field, value_json, source, confidence, datetime.now(UTC).isoformat(timespec="seconds"), source == "user", status)
        self.append("value", self.spark.createDataFrame([row], TABLES["value"]))

    def values(self) -> DataFrame:
        """Value rows as reviewers decided on them, equal ones merged; of several that users preferred, the last is."""
        merged = profile.merge_values(state.decided_values(self.table("value"), self._field_decisions()))
        last = merged.where("preferred").groupBy("language_id", "grp", "field").agg(F.max("seq").alias("last"))
        return merged.join(last, ["language_id", "grp", "field"], "left").withColumn("preferred", F.coalesce(F.col("seq") == F.col("last"), F.lit(False))).drop("last", "key")

    def profile_status(self) -> DataFrame:
        return profile.group_states(profile.field_states(self.values(), self.languages().select(F.col("id").alias("language_id"))))

    def profile_json(self) -> DataFrame:
        return profile.to_json(self.values())

    # ------------------------------------------------------------ taking in
    def _languages(self) -> DataFrame:
        return self.languages().select(F.col("id").alias("language_id"), "iso", "name")

    def _terms(self) -> DataFrame:
        return profile.terms(self.values()).withColumn("weak", F.lit(False))

    def _taken_first(self, name: str) -> bool:
        """Make an empty file that nobody has made yet; whether that worked. Local disks and Hadoop's stores each have one atomic way."""
        path, files_ = self._path(name)
        if files_.getScheme() == "file":
            local = path.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        if files_.exists(path):
            return False
        try:
            files_.create(path, False).close()
        except Py4JJavaError as e:
            if not files_.exists(path):
                raise e
            return False
        return True

    def open_session(self, language: str, mode: str) -> str:
        """A new session, running. Its number is taken by making a file that nobody else can make again, so two writers never get the same."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        started = datetime.now(UTC)
        number = 1
        while True:
            session = f"COL-{started:%Y%m%d}-{number:03d}"
            if self._taken_first(f"_sessions/{session}"):
                break
            number += 1
        self.append("session", self.spark.createDataFrame([(session, language, mode, "running", started)], TABLES["session"]))
        return session

    def finish(self, session: str, status: str = "finished") -> None:
        """A session's last state: finished, interrupted or failed."""
        self.append("session", self.spark.createDataFrame([(session, None, None, status, None)], TABLES["session"]))

    def event(self, session: str, message: str, level: str = "info") -> None:
        self.append("event", self.spark.createDataFrame([(session, level, message, datetime.now(UTC))], TABLES["event"]))
        if self.on_message:
            self.on_message(message)

    def take_in(self, candidates: DataFrame, language: str, mode: str) -> DataFrame:
        """A session: candidates (path, content, method and what else is known) to outcomes, texts, near duplicates and review items.

        The session is there, running, before anything else is; it ends as finished, interrupted or failed. What an unfinished one has
        written stays: taking the same candidates in again links what is held and adds the rest.
        """
        session = self.open_session(language, mode)
        try:
            mine = self._taken(candidates, language, session)
            if self.open_archives:
                self._members_taken(candidates, mine, language, session)
            self._near(language, session)
        except KeyboardInterrupt:
            self.finish(session, "interrupted")
            raise
        except Exception as e:
            self.event(session, f"{type(e).__name__}: {str(e)[:300]}", "error")
            self.finish(session, "failed")
            raise
        self.finish(session)
        return self.table("outcome").where(F.col("session_id") == session)

    def _taken(self, candidates: DataFrame, language: str, session: str, terms: DataFrame | None = None) -> DataFrame:
        """Candidates to rows of all tables; terms: those of the language, if a search has learned more than its profile has."""
        c = candidates.withColumns({"session_id": F.lit(session), "language_id": F.lit(language), "candidate_id": F.concat(F.lit(session + ":"), "path")})
        for k in ("url", "original_path"):
            if k not in c.columns:
                c = c.withColumn(k, F.lit(None).cast("string"))
        c = c.withColumn("seq", F.xxhash64("path"))
        before = self.table("outcome").where(F.col("session_id") == session).select("candidate_id")
        out = ingest.outcomes(ingest.checked(c), self._languages(), self._terms() if terms is None else terms, self.resources().select("sha256"), ingest.Limits(self.review_at, self.confirmed_at))
        self.append("outcome", out)
        mine = self.table("outcome").where(F.col("session_id") == session).join(before, "candidate_id", "left_anti")
        self.append("find", ingest.provenance(mine, c))
        self.append("item", ingest.review_items(mine.withColumn("title", F.lit(None).cast("string"))))
        fresh = mine.where(F.col("status").isin("stored", "uncertain_review"))
        bodies = c.select("candidate_id", "content").join(fresh.select("candidate_id", "sha256", "format", "category"), "candidate_id")
        texts = extract.extract_texts(bodies.select("sha256", "content", "format", "category"), "sha256").where("text <> ''")
        place = self.append("text", texts.withColumn("language_id", F.lit(language)))
        texts = self.spark.read.schema(f"{TABLES['text']}, seq {SEQ}").parquet(place)  # those of fresh and no others, so nothing is joined; the index takes a sketch that is there twice once
        self.append("sketch", neardup.signatures(texts, "sha256").select(F.col("id").alias("sha256"), F.lit(language).alias("language_id"), "sketch", F.lit(session).alias("session_id")))
        if self.on_outcome:
            self.on_outcome(mine)
        return mine

    def _members_taken(self, candidates: DataFrame, mine: DataFrame, language: str, session: str) -> None:
        """The files in archives that were stored, taken in as candidates of the archive's method and terms; archives among them, too."""
        known = [k for k in ("method", "user_asserted", "discovery_confidence", "matched_terms", "url") if k in candidates.columns]
        held = candidates.select("path", "content", *known)
        for _ in range(ARCHIVE_DEPTH):
            new = mine.where("category = 'archives' AND status IN ('stored', 'uncertain_review')").select("path", "format")
            archives = held.join(new, "path").withColumnRenamed("path", "archive")
            files_ = extract.archive_members(archives.select("archive", "content", "format"), "archive", contents=True).where("NOT is_folder AND content IS NOT NULL AND path IS NOT NULL")
            name = F.concat("archive", F.lit("!"), "path")
            held = files_.withColumnRenamed("content", "body").join(archives.drop("format", "content"), "archive").select(name.alias("path"), F.col("body").alias("content"), *known).dropDuplicates(["path"])
            if held.isEmpty():
                return
            mine = self._taken(held.withColumn("original_path", F.col("path")), language, session)

    def _near(self, language: str, session: str) -> None:
        """Pairs of the language's texts of which one at least is new, by the index of its sketches: it reads what may be near the new ones, not all that is held."""
        fresh = self.table("sketch").where((F.col("language_id") == language) & (F.col("session_id") == session)).select(F.col("sha256").alias("id"), "sketch")
        index = SketchIndex(self.spark, f"{self.root}/_near/{language}", self.near_at)

        def keep(near: DataFrame, copies: DataFrame) -> None:
            pairs = near.select(F.least("rep_a", "rep_b").alias("resource_id"), F.greatest("rep_a", "rep_b").alias("other_id"), (F.col("shared") / F.col("size")).alias("similarity"))
            self.append("near", pairs.unionByName(copies.select(F.col("rep").alias("resource_id"), F.col("id").alias("other_id"), F.lit(1.0).alias("similarity"))))

        index.add(fresh, keep)
        if len(index.parts()) > MOST_PARTS:
            index.compact()

    def import_folder(self, root: str, language: str) -> DataFrame:
        """Everything under a folder belongs to the language: the user says so."""
        found = files.read_tree(self.spark, root)
        return self.take_in(found.select("path", "content", F.lit("import").alias("method"), F.lit(True).alias("user_asserted")), language, "import")

    def scan_folder(self, root: str, language: str) -> DataFrame:
        """Files whose names or folders say they belong to the language."""
        from verbena.operators.relevance import detection

        found = files.scannable(files.read_tree(self.spark, root), root)
        terms = profile.scan_terms(self.values(), self._languages()).where(F.col("language_id") == language)
        hits = detection(found.select(F.col("path").alias("file_id"), "name", "folder"), terms)
        c = found.join(hits.select(F.col("file_id").alias("path"), "detection_confidence", "matched_terms"), "path")
        return self.take_in(c.select("path", "content", F.lit("offline").alias("method"), F.col("detection_confidence").alias("discovery_confidence"), "matched_terms"), language, "offline")

    # ------------------------------------------------------------ searching
    def search(self, language: str, ask: Callable[[DataFrame], DataFrame], fetch: Callable[[DataFrame], DataFrame] | None = None, download: Callable[[DataFrame], DataFrame] = http.fetch, limits: search.SearchLimits | None = None, queries: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
        """A session: queries asked and learned in rounds, files and pages about the language taken in, facts proposed for review. Its outcomes.

        ask, fetch: see search.search_rounds(), search.engines() and search.pages_of(). download takes url and returns http.SCHEMA.
        """
        limits = limits or search.SearchLimits(review_at=self.review_at, confirmed_at=self.confirmed_at)
        session = self.open_session(language, "agent")
        try:
            found = self._searched(language, ask, fetch, limits, queries, index)
            n = self._propose(found, language, session)
            self.append("taught", found.learned.select(F.lit(session).alias("session_id"), F.lit(language).alias("language_id"), "value", "signal", F.col("key").alias("source_ref")))
            files_ = found.files(self._one(language), limits).where("action = 'download'")
            bodies = download(files_.select("url")).where("error IS NULL")
            scores = found.last_scores()
            loaded = files_.join(bodies, "url").select(web.response_filename(F.col("url"), F.col("disposition")).alias("name"), "url", F.col("body").alias("content"), (F.col("score") / 100.0).alias("discovery_confidence"), F.lit(None).cast("string").alias("title"))
            sure = found.pages.join(scores.where(F.col("score") >= limits.confirmed_at), "key")
            kept = sure.select(F.concat(F.substring(F.sha2("key", 256), 1, 16), F.lit(".txt")).alias("name"), "url", F.encode(F.concat_ws("\n", "title", "text"), "UTF-8").alias("content"), (F.col("score") / 100.0).alias("discovery_confidence"), "title")
            candidates = loaded.unionByName(kept).select(F.concat(F.substring(F.sha2("url", 256), 1, 16), F.lit("/"), "name").alias("path"), "content", "url", "title", "discovery_confidence", F.lit("agent").alias("method"))
            self._taken(written(candidates, "search-candidates"), language, session, found.terms)
            self._near(language, session)
            self.event(session, f"search complete: {found.queries.count()} queries, {found.pages.count()} pages, {found.learned.count()} names, {n} proposals")
        except KeyboardInterrupt:
            self.finish(session, "interrupted")
            raise
        except Exception as e:
            self.event(session, f"{type(e).__name__}: {str(e)[:300]}", "error")
            self.finish(session, "failed")
            raise
        self.finish(session)
        return self.table("outcome").where(F.col("session_id") == session)

    def enrich(self, language: str, ask: Callable[[DataFrame], DataFrame], fetch: Callable[[DataFrame], DataFrame] | None = None, index: DataFrame | None = None) -> int:
        """A short pass that only learns: what pages say of the language is proposed for review, nothing is stored. How many proposals there are."""
        session = self.open_session(language, "agent")
        queries = self._queries(language).where(F.col("basis").isin("name", "code"))
        n = self._propose(self._searched(language, ask, fetch, search.ENRICH, queries, index), language, session)
        self.event(session, f"profile enrichment complete: {n} proposals")
        self.finish(session)
        return n

    def search_catalogues(self, language: str, entries: list[dict], fetched: Callable[[DataFrame], DataFrame] = http.fetch, download_at: int | None = 50, most_bytes: int = 500_000_000, most_files: int = 25) -> DataFrame:
        """A session: catalogues asked, results scored before anything is loaded, files and records taken in. Its outcomes; lookups and totals are in its events.

        download_at: files of results under this score are not loaded (None: of all that are relevant).
        """
        session = self.open_session(language, "catalogue")
        try:
            one = self._one(language).first()
            terms = self._terms().where(F.col("language_id") == language)
            asked = online.requests(entries, self._queries(language).select("query"), one.name, one.iso)
            found, failed = online.results(entries, asked, fetched)
            rows = written(online.decided(found, self._one(language), terms, self.review_at, download_at), "catalogue-results")
            told = rows.select(F.lit(session).alias("session_id"), "action", "n_files", F.lit(None).cast("string").alias("error")).unionByName(failed.select(F.lit(session).alias("session_id"), F.lit(None).cast("string").alias("action"), F.lit(0).alias("n_files"), "error"))
            totals = state.catalogue_totals(told).first()
            candidates = written(online.candidates(rows, fetched, most_bytes, most_files), "catalogue-candidates")
            self._taken(candidates, language, session)
            self._near(language, session)
            links = rows.where("action = 'lookup'").select("provider", "title", "url", "query").withColumns({"kind": F.lit("lookup"), "session_id": F.lit(session)})
            for r in sinks.lookup_manifest(links).collect():  # a row for this session
                self.event(session, r.json, "lookups")
            if totals is not None:
                self.event(session, ", ".join(f"{k}: {v}" for k, v in totals.asDict().items() if k != "session_id"))
        except KeyboardInterrupt:
            self.finish(session, "interrupted")
            raise
        except Exception as e:
            self.event(session, f"{type(e).__name__}: {str(e)[:300]}", "error")
            self.finish(session, "failed")
            raise
        self.finish(session)
        return self.table("outcome").where(F.col("session_id") == session)

    def _one(self, language: str) -> DataFrame:
        return self._languages().where(F.col("language_id") == language)

    def _queries(self, language: str) -> DataFrame:
        """query, basis, rank for a language by what its profile says."""
        one = self._one(language)
        kinds = {"alternate_name": "alternate_name", "exonym": "exonym", "variety": "variety", "geographic": "place", "community": "community", "known_publication": "publication", "known_translation": "translation"}
        kind = F.create_map(*(F.lit(x) for k, v in kinds.items() for x in (k, v)))
        told = self._terms().join(one.select("language_id", "name"), "language_id").select("language_id", "name", kind[F.col("signal")].alias("kind"), "term", "seq").where("kind IS NOT NULL")
        own = one.select("language_id", "name", F.explode(F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("term")), F.struct(F.lit("code").alias("kind"), F.col("iso").alias("term")))).alias("t"))
        own = own.where("t.term IS NOT NULL").select("language_id", "name", "t.kind", "t.term", F.lit(0).alias("seq"))
        return discover.search_queries(own.unionByName(told)).select("query", "basis", "rank")

    def _searched(self, language: str, ask, fetch, limits: search.SearchLimits, queries: DataFrame | None, index: DataFrame | None) -> search.Found:  # noqa: ANN001
        q = self._queries(language) if queries is None else queries
        return search.search_rounds(q, ask, fetch or search.pages_of(), self._one(language), self._terms().where(F.col("language_id") == language), index=index, limits=limits)

    def _propose(self, found: search.Found, language: str, session: str) -> int:
        """Facts that are new become proposed values, each with an item for review."""
        new = written(search.proposals(found.facts, self.values(), language), "proposals")
        at = F.lit(datetime.now(UTC).isoformat(timespec="seconds"))
        self.append("value", new.select("language_id", "grp", "field", "value_json", F.lit("agent").alias("source_type"), "confidence", at.alias("recorded_at"), F.lit(False).alias("preferred"), F.lit("proposed").alias("status")))
        payload = F.to_json(F.struct("grp", "field", "value_json", "quote", F.lit("agent").alias("source_type"), "source_ref"))
        name = F.concat(F.lit(f"{session}:"), F.sha2(F.concat_ws("\n", "grp", "field", "value_json"), 256))
        self.append("item", new.select(name.alias("item_id"), "language_id", F.lit(session).alias("session_id"), F.lit("profile_field").alias("kind"), payload.alias("payload"), "confidence"))
        return new.count()

    # ------------------------------------------------------------ asking
    def resources(self) -> DataFrame:
        return state.new_resources(ingest.resources(self.table("outcome")), self.spark.createDataFrame([], "sha256 string"))

    def sessions(self) -> DataFrame:
        """Sessions with their last state, the name of their language and their counters, the latest first."""
        counters = state.session_counters(self.table("outcome"))
        rows = state.sessions(self.table("session")).join(counters, "session_id", "left")
        names = self.languages().select(F.col("id").alias("language_id"), F.col("name").alias("language"))
        return rows.join(names, "language_id", "left").orderBy(F.desc("started_at"), F.desc("session_id"))

    def unfinished(self) -> DataFrame:
        """Sessions that never ended well: taking their candidates in again completes them."""
        return state.sessions(self.table("session")).where("status <> 'finished'")

    def near_duplicates(self) -> DataFrame:
        return state.near_duplicates(self.table("near"))

    def reviews(self) -> DataFrame:
        return state.review_items(self.table("item"), self.table("decision"))

    def decide(self, item: str, decision: str, by: str = "user") -> None:
        """Decide on an item: accepted or rejected, its value or its resource changes with it; skipped, nothing does. The last decision counts."""
        if decision not in ("accepted", "rejected", "skipped"):
            raise ValueError(f"unknown decision {decision}")
        self.append("decision", self.spark.createDataFrame([(item, decision, by)], TABLES["decision"]))

    def _decisions(self, kind: str, *parts: str) -> DataFrame:
        """language_id, parts of the payload, decision, seq of all decisions on items of a kind."""
        items = self.table("item").where(F.col("kind") == kind).groupBy("item_id").agg(F.min_by("language_id", "seq").alias("language_id"), F.min_by("payload", "seq").alias("payload"))
        part = [F.get_json_object("payload", f"$.{p}").alias(p) for p in parts]
        return self.table("decision").join(items, "item_id").select("language_id", *part, "decision", "seq")

    def _field_decisions(self) -> DataFrame:
        return self._decisions("profile_field", "grp", "field", "value_json")

    def review_summary(self) -> DataFrame:
        return state.review_summary(self.reviews(), self.languages())

    def home(self) -> dict[str, int]:
        """Counts for an overview."""
        row = state.home(self.resources(), self.reviews(), self.languages()).first()
        return {"languages": row.languages, "resources": row.resources, "bytes": int(row.bytes), "pending": row.pending_resources + row.pending_facts}

    def listing(self, language: str) -> DataFrame:
        """A language's resources with their status, the largest score first; those that a reviewer rejected are left out."""
        best = self.table("outcome").where((F.col("language_id") == language) & F.col("status").isin("stored", "uncertain_review", "duplicate_linked")).groupBy("sha256").agg(F.max("score").alias("score"))
        held = self.resources().select("sha256", "name", "size", "format", "category").join(best, "sha256").withColumn("language_id", F.lit(language))
        decided = state.decided_resources(held, self._decisions("resource", "sha256"), self.confirmed_at)
        return decided.where("status <> 'rejected'").drop("language_id").orderBy(F.desc("score"), "sha256")

    def review_sources(self) -> DataFrame:
        """What lies behind the items that a person has to decide."""
        items = self.reviews().where("kind = 'resource'").select("item_id", F.get_json_object("payload", "$.sha256").alias("sha256"))
        return state.review_sources(items, self.resources(), self.table("text"))
