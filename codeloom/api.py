"""What callers use: index a source tree into a store, and ask it."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from .config import Config, test_patterns
from .functions import scalar as fn
from .functions.embed import embedded, query_vector
from .functions.lineage import checkpointed
from .operators import assemble, graph, rank, store, temporal, text, vector
from .sources import parse, scan
from .streaming import streams


def scoped(df: DataFrame, scope: str) -> DataFrame:
    """impl (and any unknown scope) leaves tests out, test keeps only tests, all keeps all."""
    return df if scope == "all" else df.where("is_test") if scope == "test" else df.where("not is_test")


class Engine:
    """One project's index. With `project`, projects share a root and are kept apart by folder; each is registered once."""

    SEGMENTS = 8

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, project: str | None = None, embedder: str = "hashing"):
        self.spark, self.config, self.embedder = spark, config or Config(), embedder
        self.project_id = self.config.project_id
        if project is not None:
            self.project_id = self._register(store.Store(spark, root), project)
            root = f"{root.rstrip('/')}/project_id={self.project_id}"
        self.store = store.Store(spark, root)
        self.generation, self.hits = 0, {}

    def _register(self, shared: store.Store, name: str) -> int:
        """The project's id; a new one gets the next."""
        known = shared.read("projects")
        found = known.where(F.col("name") == name).agg(F.min("id")).first()[0] if known is not None else None
        if found is None:
            found = (known.agg(F.max("id")).first()[0] or 0) + 1 if known is not None else 1
            shared.commit({"projects": self.spark.createDataFrame([(found, name)], "id long, name string")}, append=("projects",))
        return found

    # --- settings
    def set(self, key: str, value: str) -> None:
        self.store.commit({"config": self._settings({key: value})})

    def _settings(self, values: dict[str, str]) -> DataFrame:
        new = self.spark.createDataFrame(list(values.items()), "key string, value string")
        old = self.store.read("config")
        return new if old is None else store.upsert(old, new, ["key"])

    def get(self, key: str, default: str | None = None) -> str | None:
        rows = self.store.read("config")
        row = rows.where(F.col("key") == key).first() if rows is not None else None
        return row["value"] if row else default

    # --- indexing
    def index(self, source: str, ignore: list[str] = (), embed: bool = True) -> dict[str, int]:
        """Scan, parse what changed, resolve edges, log differences, and commit at once. Files that are gone are removed and leave a
        `delete` in the log. Where nothing changed nothing is written."""
        found = scan.scan(self.spark, source, list(ignore))
        counts = self.apply(found, whole=True, settings={"source": source})
        if embed and (counts["changed"] or self.store.read("embeddings") is None):
            counts |= self.embed()
        return {k: v for k, v in counts.items() if k in ("changed", "deleted", "errors") or v}

    def apply(self, found: DataFrame, whole: bool = False, settings: dict[str, str] | None = None) -> dict[str, int]:
        """Bring the index up to the files of `found` (as `scan` gives them); with `whole` these are all there are.

        Set by set in one commit: symbols before, chunks and symbols anew, differences, edges, pending edges that now resolve.
        """
        found = found.withColumn("is_test", fn.is_test(F.col("path"), test_patterns())).cache()
        old_files = self.store.read("files")
        known = old_files if old_files is not None else found.limit(0).withColumn("serial", F.lit(0).cast("long"))
        new = store.changed(found, known, "path").cache()
        gone = known.join(found.select("path"), "path", "left_anti").select("path") if whole else known.limit(0).select("path")
        gone = gone.cache()
        counts = {"changed": new.count(), "deleted": gone.count(), "errors": 0}
        try:
            if counts["changed"] or counts["deleted"] or old_files is None:
                counts["errors"] = self._commit(new, gone, known, old_files is None, settings or {})
        finally:  # a later call must list the files anew
            for df in (new, gone, found):
                df.unpersist()
        return counts

    def _commit(self, new: DataFrame, gone: DataFrame, known: DataFrame, first_time: bool, settings: dict[str, str]) -> int:
        serial = self.store.pointer["serial"] + 1
        touched = new.select("path").union(gone)
        parts = [r[0] for r in touched.select(store.Store.part()).distinct().collect()]  # PARTS numbers at most
        rows = parse.parse_files(new).cache()
        try:
            chunks = parse.tagged(rows, "chunk").select(F.xxhash64("path", "chunk_index").alias("chunk_id"), "path", "chunk_index", "kind", F.col("name").alias("symbol_name"), "signature", "parent", "start_line", "end_line", "token_count", F.size(fn.tokens(F.concat_ws(" ", "content", "name"))).alias("n_terms"), "content")
            symbols = parse.tagged(rows, "symbol").join(new.select("path", "language"), "path").select(F.xxhash64("path", "name", "start_line").alias("symbol_id"), "path", "name", "kind", F.col("start_line").alias("line"), "signature", "visibility", "exported", "language")
            named = parse.tagged(rows, "edge").join(new.select("path", "language"), "path").select("path", F.col("name").alias("src_name"), F.col("target").alias("dst_name"), "qualified", "kind", "language").distinct()
            now = datetime.now(timezone.utc).replace(tzinfo=None)

            def before(name: str, like: DataFrame) -> DataFrame:
                """What the table had for touched files."""
                rows = self.store.read(name, parts)
                return like.limit(0) if rows is None else rows.join(touched, "path", "left_semi")

            def joined(name: str, df: DataFrame) -> DataFrame:
                """The touched parts of the table as they will be."""
                rows = self.store.read(name, parts)
                return df if rows is None else rows.join(touched, "path", "left_anti").unionByName(df)

            def all_of(name: str, df: DataFrame) -> DataFrame:
                rows = self.store.read(name)
                return df if rows is None else rows.join(touched, "path", "left_anti").unionByName(df)

            first = lambda df: df.groupBy("path", "name").agg(F.min_by("signature", "line").alias("signature"), F.min("line").alias("line"))
            key = lambda df: first(df).withColumn("key", F.concat_ws("\x01", "path", "name"))
            changes = temporal.symbol_diff(key(before("symbols", symbols)), key(symbols), "key").select(F.split("key", "\x01")[0].alias("path"), F.split("key", "\x01")[1].alias("name"), F.col("change"), F.lit(now).cast("timestamp_ntz").alias("ts"))
            span = lambda df, n: df.groupBy("path").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias(n))
            log = touched.join(span(chunks, "a"), "path", "left").join(span(before("chunks", chunks), "b"), "path", "left").join(gone.withColumn("gone", F.lit(True)), "path", "left")
            a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
            log = log.select("path", F.lit(now).cast("timestamp_ntz").alias("ts"), F.when(F.col("gone"), "delete").when(F.col("b").isNull(), "add").otherwise("modify").alias("change"), F.greatest(a - b, F.lit(0)).alias("lines_added"), F.greatest(b - a, F.lit(0)).alias("lines_removed"))
            all_symbols, all_named = all_of("symbols", symbols), all_of("named_edges", named)
            # Sources are the least symbol of the name in the file; targets by file, language, or anywhere.
            src = all_symbols.groupBy("path", F.col("name").alias("src_name")).agg(F.min_by("symbol_id", "line").alias("src"))
            ready = all_named.join(src, ["path", "src_name"]).select("src", "dst_name", "qualified", "kind", F.col("path").alias("file"), "language")
            resolved, pending = graph.resolve(ready, all_symbols.select("symbol_id", "name", F.col("path").alias("file"), "language"))
            errors = parse.tagged(rows, "error").select("path", F.lit(True).alias("failed"))
            files = new.drop("content").join(errors, "path", "left").withColumn("parse_quality", F.when(F.col("failed"), "error").otherwise("full")).drop("failed").withColumn("serial", F.lit(serial).cast("long"))
            tables = {"files": files if first_time else joined("files", files), "chunks": joined("chunks", chunks), "symbols": joined("symbols", symbols), "named_edges": joined("named_edges", named), "edges": resolved, "pending": pending, "diff_log": log, "diff_symbols": changes}
            for name in ("embeddings", "embed_errors"):  # vectors of chunks that are no more
                if self.store.read(name) is not None:
                    kept = self.store.read(name, parts)
                    tables[name] = kept.join(touched, "path", "left_anti")
            segments = [x for x in (self.get("segments") or "").split(",") if x]
            body = chunks.withColumn("serial", F.lit(serial).cast("long"))
            if len(segments) >= self.SEGMENTS:  # all postings anew, in one segment
                segments = []
                old = self.store.read("chunks").join(touched, "path", "left_anti").join(known.select("path", "serial"), "path")
                body = old.unionByName(body)
            segment = f"text/s{serial}"
            text.Index.build(body.withColumn("text", F.concat_ws(" ", "content", "symbol_name")), f"{self.store.root}/{segment}", "chunk_id", keep=["path", "serial"])
            tables["config"] = self._settings(settings | {"segments": ",".join([*segments, segment])})
            self.store.commit(tables, parts=None if first_time else parts, append=("diff_log", "diff_symbols"))
            return errors.count()
        finally:
            rows.unpersist()

    def embed(self, batch: int | None = None) -> dict[str, int]:
        """Vectors of the chunks that have none. What the embedder refuses or fails at, time and again, is noted and left alone."""
        chunks, vectors, failed = self.store.read("chunks"), self.store.read("embeddings"), self.store.read("embed_errors")
        waiting = chunks.select("chunk_id", "path", "content")
        for known in (vectors, failed):
            waiting = waiting if known is None else waiting.join(known.select("chunk_id"), "chunk_id", "left_anti")
        done = embedded(waiting, "chunk_id", "content", self.embedder, batch or self.config.embed_batch).join(waiting.select("chunk_id", "path"), "chunk_id").cache()
        try:
            fault = fn.vector_fault(F.col("embedding"), len(query_vector("", self.embedder)))
            marked = done.withColumn("error", F.coalesce("error", fault))
            good = marked.where("error is null").select("chunk_id", "path", "embedding")
            bad = marked.where("error is not null").select("chunk_id", "path", "error")
            join = lambda old, df: df if old is None else old.unionByName(df)
            counts = {"embedded": good.count(), "refused": bad.count()}
            if any(counts.values()) or vectors is None:
                self.store.commit({"embeddings": join(vectors, good), "embed_errors": join(failed, bad)})
            return counts
        finally:
            done.unpersist()

    def embed_page(self, after: int | None = None, limit: int = 256, done: bool = False) -> DataFrame:
        """Ids of chunks without a vector (with `done`: with one) beyond an id, in order: a page of a scan that can be resumed."""
        rows = self.store.read("embeddings") if done else self.store.read("chunks").join(self.store.read("embeddings").select("chunk_id"), "chunk_id", "left_anti")
        return store.page(rows, "chunk_id", after, limit)

    def follow(self, source: str, checkpoint: str, files_a_batch: int = 1000, many: int = 20) -> StreamingQuery:
        """Bring the index up to files that are new or changed since the last call; after many at once, by a scan of all."""
        return streams.on_changes(streams.file_changes(self.spark, source, files_a_batch), "path", self.apply, lambda: self.index(source, embed=False), checkpoint, many)

    def purge(self) -> None:
        self.store.purge()
        self.store.fs.delete(self.store._path("text"), True)

    def _chunks(self, scope: str = "all", path: str = "") -> DataFrame:
        files = self.store.read("files").select("path", "language", "is_test")
        return scoped(self.store.read("chunks").join(files, "path"), scope).where(F.col("path").startswith(path))

    # --- asking
    def level(self) -> str:
        chunks, vectors = self.store.read("chunks"), self.store.read("embeddings")
        return rank.level(0 if chunks is None else chunks.count(), 0 if vectors is None else vectors.count())

    def search(self, query: str, max_results: int | None = None, min_score: float | None = None, scope: str = "impl", path: str = "", record: bool = True) -> DataFrame:
        """Best chunks, parts of a split symbol as one. Without an index: files in the order of their paths, as far as the budget goes."""
        n, floor = self.config.max_results if max_results is None else max_results, self.config.min_score if min_score is None else min_score
        if len(query) > 10_000 or not 1 <= n <= 200 or not 0 <= floor <= 1:
            raise ValueError("query of at most 10000 characters, max_results 1..200, min_score 0..1")
        level = self.level()
        columns = ["path", "symbol_name", "kind", "start_line", "end_line", "token_count", "score", "content"]
        if level == "filesystem":
            return self._from_files(self.config.token_budget).select(*columns).limit(n)
        chunks = self._chunks(scope, path)
        best = self._ranked(chunks, query, n, floor, level, scope, path)
        out = assemble.merged_hits(best, chunks).select(*columns).orderBy(F.desc("score"), "path", "start_line")
        if record:
            self.record([(r["path"], r["start_line"]) for r in out.select("path", "start_line").collect()])
        return out

    def _from_files(self, budget: int) -> DataFrame:
        rows = scan.scan(self.spark, self.get("source") or self.config.root).withColumn("tok", fn.token_estimate(F.col("content")))
        found = assemble.fallback(rows, budget)
        content = F.substring(F.col("content"), F.lit(1), F.col("token_count") * 4)
        return found.select("path", F.lit(None).cast("string").alias("symbol_name"), F.lit("file").alias("kind"), F.lit(1).alias("start_line"), F.size(F.split(content, "\n")).alias("end_line"), "token_count", "score", content.alias("content"))

    def _keyword(self, query: str, scope: str, path: str) -> DataFrame:
        """(chunk_id, rank) from stored postings; those of files that changed since are dead."""
        files = scoped(self.store.read("files"), "all").select("path", "serial", "is_test")
        parts = [text.Index(self.spark, f"{self.store.root}/{x}", "chunk_id") for x in (self.get("segments") or "").split(",") if x]
        terms = sorted({w.lower() for w in fn.sanitize_query(query)})
        hits = reduce(DataFrame.unionByName, [p.postings(terms) for p in parts]).join(files, ["path", "serial"])
        inside = {"all": F.lit(True), "test": F.col("is_test")}.get(scope, ~F.col("is_test")) & F.col("path").startswith(path)
        n, total = self.store.read("chunks").agg(F.count("*"), F.sum("n_terms")).first()
        return text.ranked(hits.withColumn("in_scope", inside), n, (total or 0) / n if n else 0.0, "chunk_id")

    def _ranked(self, chunks: DataFrame, query: str, n: int, floor: float, level: str, scope: str, path: str = "") -> DataFrame:
        keyword = checkpointed(self._keyword(query, scope, path).select("chunk_id", F.round(fn.keyword_norm(F.col("rank")), 6).alias("keyword")).orderBy(F.desc("keyword"), "chunk_id").limit(2 * n))
        signals, found = {"keyword": keyword}, keyword.select("chunk_id")
        semantic = level in ("hybrid", "mixed")
        if semantic:
            asked = list(query_vector(self.config.query_prefix + query, self.embedder))
            near = checkpointed(vector.top_k(self.store.read("embeddings").join(chunks.select("chunk_id"), "chunk_id", "left_semi"), asked, 2 * n, "chunk_id"))
            signals["semantic"] = near.select("chunk_id", ((F.col("score") + 1) / 2).alias("semantic"))
            found = found.union(near.select("chunk_id")).distinct()
        own = chunks.join(found, "chunk_id", "left_semi")
        signals["structural"] = graph.structural_score(found, self._symbols_of(own), self.store.read("edges")).withColumnRenamed("score", "structural")
        log = self.store.read("diff_log").groupBy("path").agg(F.max_by(F.struct("ts", (F.col("lines_added") + F.col("lines_removed")).alias("n")), "ts").alias("d"))
        hours = (F.lit(datetime.now(timezone.utc).timestamp()) - F.unix_micros(F.col("d.ts").cast("timestamp")) / 1e6) / 3600
        signals["change"] = own.join(log, "path").select("chunk_id", fn.decay_change(hours, F.col("d.n")).alias("change"))
        if self.hits:
            rows = self.spark.createDataFrame([(p, line, self._session(v)) for (p, line), v in self.hits.items()], "path string, start_line int, session double")
            signals["session"] = own.join(F.broadcast(rows), ["path", "start_line"]).select("chunk_id", "session")
        return checkpointed(rank.blend(found, signals, rank.weights(semantic, bool(self.hits)), "chunk_id", n, floor))

    def _symbols_of(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, symbol_id)"""
        ids = self.store.read("symbols").groupBy("path", "name").agg(F.min("symbol_id").alias("symbol_id"))
        return chunks.select("chunk_id", "path", F.col("symbol_name").alias("name")).join(ids, ["path", "name"]).select("chunk_id", "symbol_id")

    def context(self, query: str, budget: int | None = None, scope: str = "impl") -> DataFrame:
        """Chunks for a budget of tokens: the best ones, the first cut to the budget, then neighbours of them that 30 per cent of what
        is left hold. Without an index: files."""
        budget = self.config.token_budget if budget is None else budget
        if not 256 <= budget <= 32768:
            raise ValueError("budget must lie in 256..32768")
        level = self.level()
        columns = ["position", "path", "symbol_name", "start_line", "end_line", "token_count", "content"]
        if level == "filesystem":
            return self._from_files(budget).withColumn("position", F.row_number().over(W.orderBy("path")) - 1).select(*columns).orderBy("position")
        chunks = self._chunks(scope)
        best = checkpointed(assemble.merged_hits(self._ranked(chunks, query, 200, 0.0, level, scope), chunks))
        packed = checkpointed(assemble.pack_budget(best.select(F.col("chunk_id").alias("id"), "path", "start_line", "end_line", "token_count", "score"), budget))
        n, used = packed.agg(F.count("*"), F.sum("token_count")).first()
        if n and used < budget:
            chosen = self._symbols_of(best.join(packed.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"))
            near = graph.neighbours(self.store.read("edges"), chosen.select(F.col("symbol_id").alias("seed")), 1, "both").select(F.col("node").alias("symbol_id")).distinct()
            left = best.join(packed.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
            others = left.join(self._symbols_of(left).join(near, "symbol_id", "left_semi").select("chunk_id").distinct(), "chunk_id", "left_semi")
            more = assemble.expand(others.select(F.col("chunk_id").alias("id"), "token_count", "score"), budget - used)
            packed = packed.unionByName(more.join(others.select(F.col("chunk_id").alias("id"), "token_count"), "id").select((F.col("position") + n).alias("position"), "id", F.col("token_count").cast("int").alias("token_count")))
        rows = packed.select("position", F.col("id").alias("chunk_id"), F.col("token_count").alias("given")).join(best, "chunk_id")
        cut = assemble.truncate(F.col("content"), budget)
        short = F.col("given") < F.col("token_count")
        content = F.when(short, F.array_join(F.slice(F.split("content", "\n"), F.lit(1), cut["lines"]), "\n")).otherwise(F.col("content"))
        return rows.select("position", "path", "symbol_name", "start_line", F.when(short, F.col("start_line") + cut["lines"] - 1).otherwise(F.col("end_line")).alias("end_line"), F.col("given").alias("token_count"), content.alias("content")).orderBy("position")

    def context_package(self, query: str, budget: int | None = None, scope: str = "impl") -> dict:
        """The context as one value: its chunks, their tokens in all, and how they were found."""
        rows = [r.asDict() for r in self.context(query, budget, scope).collect()]
        return {"strategy": self.level(), "total_tokens": sum(r["token_count"] for r in rows), "budget": self.config.token_budget if budget is None else budget, "chunks": rows}

    def evaluate(self, cases: list[dict], k: int = 10) -> DataFrame:
        """cases of query, files and symbols (names) that belong to it -> (query, recall, precision, rr) and a row `mean`."""
        results, wanted = [], []
        for case in cases:
            query = case["query"]
            wanted += [(query, x) for x in [*case.get("files", ()), *case.get("symbols", ())]]
            for at, r in enumerate(self.search(query, k, 0.0, record=False).collect(), 1):
                results += [(query, at, x) for x in (r["path"], r["symbol_name"]) if x is not None and x in {w for q, w in wanted if q == query}] or [(query, at, r["path"])]
        frame = lambda rows, ddl: self.spark.createDataFrame(rows, ddl)
        per = rank.metrics(frame(results, "query string, rank int, item string"), frame(wanted, "query string, item string"), k)
        mean = per.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("recall", "precision", "rr")]).select(F.lit("mean").alias("query"), "*")
        return per.unionByName(mean)

    def symbols(self, name: str, kind: str | None = None, scope: str = "impl") -> DataFrame:
        """Definitions; where no symbol has the name at all, the callers that refer to it."""
        files, rows = self.store.read("files").select("path", "is_test"), self.store.read("symbols")
        named = rows.where(F.col("name") == name)
        defined = scoped(named.join(files, "path"), scope).where(F.lit(kind is None) | (F.col("kind") == (kind or ""))).select("name", "kind", "path", "line", "signature", F.lit("definition").alias("role"))
        pending = self.store.read("pending").where((F.col("dst_name") == name) | (F.col("qualified") == name)).select(F.col("src").alias("symbol_id"))
        callers = scoped(rows.join(pending.distinct(), "symbol_id", "left_semi").join(files, "path"), scope)
        refs = callers.join(named.select(F.lit(1).alias("x")).limit(1), F.col("x") == 1, "left_anti").select("name", "kind", "path", "line", "signature", F.lit("referenced_by").alias("role"))
        return defined.union(refs)

    def dependencies(self, symbol: str, direction: str = "both", depth: int = 2, scope: str = "impl") -> DataFrame:
        way = {"callers": "incoming", "callees": "outgoing", "both": "both"}.get(direction)
        if way is None or not 1 <= depth <= 5:
            raise ValueError("direction callers, callees or both; depth 1..5")
        rows = self.store.read("symbols")
        seed = rows.where(F.col("name") == symbol).agg(F.min("symbol_id").alias("seed")).where("seed is not null")
        near = graph.neighbours(self.store.read("edges"), seed, depth, way).select(F.col("node").alias("symbol_id")).distinct()
        if way != "outgoing":
            waiting = self.store.read("pending").where((F.col("dst_name") == symbol) | (F.col("qualified") == symbol)).select(F.col("src").alias("symbol_id")).distinct()
            near = near.union(waiting.join(near.select(F.lit(1).alias("x")).limit(1), F.col("x") == 1, "left_anti"))
        return scoped(rows.join(near, "symbol_id", "left_semi").join(self.store.read("files").select("path", "is_test"), "path"), scope).select("name", "kind", "path", "line")

    def diff(self, since: str = "24h", limit: int = 50, scope: str = "impl") -> DataFrame:
        start = datetime.now(timezone.utc).replace(tzinfo=None) - duration(since)
        names = self.store.read("diff_symbols").groupBy("path", "ts").agg(F.sort_array(F.collect_list(F.format_string("%s (%s)", "name", "change"))).alias("affected"))
        log = self.store.read("diff_log").where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        files = self.store.read("files").select("path", "is_test")
        rows = log.join(files, "path", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))
        return scoped(rows, scope).orderBy(F.desc("ts"), "path").limit(limit if 1 <= limit <= 500 else 50).join(names, ["path", "ts"], "left").drop("is_test")

    def summary(self) -> DataFrame:
        files = self.store.read("files").agg(F.count("*").alias("files"), F.count_if(F.col("parse_quality") == "error").alias("parse_errors"))
        count = lambda n: (self.store.read(n).count() if self.store.read(n) is not None else 0)
        chunks, vectors = count("chunks"), count("embeddings")
        return files.select("*", F.lit(chunks).alias("chunks"), F.lit(count("symbols")).alias("symbols"), F.lit(round(100 * vectors / chunks, 2) if chunks else 0.0).alias("embedded_pct"))

    def languages(self) -> DataFrame:
        return self.store.read("files").where("language <> ''").groupBy("language").count()

    def enrichment_status(self) -> DataFrame:
        flags = self.store.read("chunks").join(self.store.read("embeddings").select("chunk_id", F.lit(True).alias("embedded")), "chunk_id", "left").withColumn("embedded", F.coalesce("embedded", F.lit(False)))
        return store.embedding_status(flags, "path").groupBy("embedding_status").agg(F.count("*").alias("files"))

    # --- session
    def record(self, seen: list[tuple[str, int]], capacity: int = 2000) -> None:
        self.generation += 1
        now = datetime.now(timezone.utc).timestamp()
        for key in seen:
            count = self.hits.pop(key, (0,))[0]
            self.hits[key] = (count + 1, now, self.generation)
        while len(self.hits) > capacity:
            self.hits.pop(next(iter(self.hits)))

    def _session(self, hit: tuple[int, float, int]) -> float:
        from math import exp, log2

        count, last, generation = hit
        minutes = (datetime.now(timezone.utc).timestamp() - last) / 60
        return exp(-0.07 * minutes) * min(log2(count + 1) / 4, 1.0) * exp(-0.1 * (self.generation - generation))


def duration(text: str) -> timedelta:
    """Hours, minutes and seconds as in 1h30m; 720 hours at most."""
    import re

    if not re.fullmatch(r"(\d+(?:\.\d+)?(?:h|m|s|ms))+", text):
        raise ValueError(f"no duration: {text!r}")
    total = sum(float(n) * {"h": 3600, "m": 60, "s": 1, "ms": 0.001}[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text))
    return timedelta(seconds=min(total, 720 * 3600))
