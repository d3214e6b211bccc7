"""The tools: search, semantic search, files, explore, trace, impact, diff impact, pack, retrieve, status, remember, recall.

Each composes operators over an index or a memory and returns an ``Answer``: a
state, DataFrames by name, and signal codes.  Only what a decision needs is
collected, and that is bounded by the tool's own limits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions import text as tx
from skarn.functions.vectors import hash_embed, quantize_int8
from skarn.operators import graph, lexical, memory, packing, structure, vector
from skarn.plans.index import Index, graph_edges, staleness
from skarn.sources import diffs, notes

OK, PARTIAL, STALE, FAILED = "sucesso", "parcial", "stale", "falha"
STYLES = {"brief": (0, 0, 1, 1, 4), "balanced": (16, 120, 2, 2, 6), "deep": (400, 4000, 3, 4, 10)}  # lines, tokens, snippets, depth, budget


@dataclass
class Answer:
    state: str
    data: dict[str, DataFrame] = field(default_factory=dict)
    signals: list[str] = field(default_factory=list)


def _clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def searchable(index: Index) -> DataFrame:
    s = index.symbols
    return s.select("id", "name", "path", "kind", F.concat_ws(" ", "name", "path", "kind").alias("text"))


def search(index: Index, query: str, scope: str | None = None, kind: str | None = None, limit: int = 20) -> Answer:
    """Ranked symbols; ``ambiguous`` if the first two both equal the query."""
    if not query.strip():
        return Answer(FAILED, signals=["query is empty"])
    hits = lexical.search(searchable(index), query, _clamp(limit, 1, 100), scope, kind)
    rows = hits.join(index.symbols.select("id", "start_line", "end_line"), "id").orderBy(F.desc("score"), "name", "path", "start_line")
    top = rows.limit(2).collect()
    same = len(top) == 2 and all(r["name"].lower() == query.strip().lower() for r in top)
    return Answer("ambiguous" if same else OK if top else "empty", {"results": rows})


def embed_symbols(index: Index) -> DataFrame:
    """id, content_hash, scale, codes of every symbol's chunk by the hashing encoder."""
    body = index.symbols.join(index.files.select("path", "content"), "path")
    lines = F.slice(F.split("content", "\n"), F.col("start_line"), F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1))
    chunk = body.select("id", tx.chunk_text(F.col("path"), F.col("name"), F.col("kind"), F.array_join(lines, "\n")).alias("chunk"))
    return _embed(chunk.withColumn("content_hash", F.sha2(F.col("chunk").cast("binary"), 256)))


def _embed(chunks: DataFrame) -> DataFrame:
    made = chunks.withColumn("__v", hash_embed("chunk"))
    coded = made.select("id", "content_hash", quantize_int8(F.col("__v")).alias("q"))
    return coded.select("id", "content_hash", "q.scale", "q.codes")


def embed_incremental(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Vectors of chunks (id, chunk, content_hash): kept where the hash is stored, made where not, orphans left out."""
    keep = stored.join(chunks.select("id", "content_hash"), ["id", "content_hash"], "left_semi")
    new = chunks.join(stored.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
    return keep.select("id", "content_hash", "scale", "codes").unionByName(_embed(new))


def _dense(vectors: DataFrame, query: str, k: int, allow: DataFrame | None = None) -> DataFrame:
    spark = vectors.sparkSession
    q = spark.createDataFrame([(query,)], "chunk string").select(hash_embed("chunk").alias("embedding"))
    restored = vectors.select("id", F.transform("codes", lambda c: c.cast("float")).alias("embedding"))
    return vector.dense_topk(restored, q, k, allow, "id")


def semantic_search(index: Index, vectors: DataFrame | None, query: str, mode: str = "hybrid", scope: str | None = None, kind: str | None = None, limit: int = 20, facts: DataFrame | None = None, domain: str = "code") -> Answer:
    """Dense, lexical or fused search; without vectors it degrades to the lexical one and says so.

    ``domain`` memory searches facts alone, all fuses both by rank.
    """
    limit = _clamp(limit, 1, 50)
    wide = max(limit, 50)
    if domain == "memory":
        return recall(facts, query, limit)
    rows = index.symbols
    if scope:
        rows = rows.filter(F.contains(F.lower("path"), F.lit(scope.lower())))
    if kind:
        rows = rows.filter(F.lower("kind") == kind.lower())
    lex = vector.ranked(lexical.search(searchable(Index(index.files, rows, index.edges, index.imports)), query, wide), F.desc("score"), F.col("name"), F.col("path"), F.col("id")).select("id", "rank")
    if vectors is None or mode == "lexical":
        out = lex.filter(F.col("rank") < limit).select("id", (1.0 / (F.col("rank") + 1)).alias("score"), F.lit("lexical").alias("match_reason"))
        answer = Answer(PARTIAL if vectors is None else OK, {"results": out}, ["W_EMBEDDINGS_UNAVAILABLE"] if vectors is None else [])
    else:
        dense = _dense(vectors, query, wide, rows.select("id"))
        if mode == "dense":
            out = dense.limit(limit).select("id", tx.half_up(F.col("score")).alias("score"), F.lit("semantic").alias("match_reason"))
        else:
            out = vector.hybrid(dense, lex, limit).select("id", "score", "match_reason")
        answer = Answer(OK, {"results": out})
    named = answer.data["results"].join(index.symbols, "id")
    if domain == "all" and facts is not None:
        notes_ = recall(facts, query, limit).data["chunks"].select(F.concat(F.lit("note:"), "note_id").alias("id"), "score")
        code = answer.data["results"].select(F.concat(F.lit("symbol:"), "id").alias("id"), "score")
        lists = [vector.ranked(x, F.desc("score"), F.col("id")) for x in (code, notes_)]
        answer.data["fused"] = vector.rrf(lists).limit(limit)
    answer.data["results"] = named
    return answer


def files(index: Index, pattern: str | None = None, max_depth: int | None = None) -> Answer:
    """Files with their symbol counts; those with errors count none."""
    rows = index.files.filter("language <> 'unsupported'")
    if pattern:
        rows = rows.filter(F.contains("path", F.lit(pattern)))
    if max_depth is not None:
        rows = rows.filter(F.size(F.split("path", "/")) - 1 <= max_depth)
    whole = rows.filter(F.size("errors") == 0)
    counted = structure.file_counts(rows.select("path", "language"), index.symbols.join(whole.select("path"), "path", "left_semi"), "path")
    return Answer(OK, {"files": counted.orderBy("path"), "languages": counted.groupBy("language").agg(F.count("*").alias("files"), F.sum("total").alias("symbols"))})


def resolve(index: Index, target: str) -> tuple[str, list[str]]:
    """What a target names: ('file' | 'symbol' | 'ambiguous' | 'none', ids of at most ten candidates)."""
    paths = index.files.filter(F.lower("path") == target.lower()).select("path").limit(2).collect()
    if paths:
        return "file", [paths[0]["path"]]
    if "/" in target or "." in target:
        part = [r["path"] for r in index.files.filter(F.contains(F.lower("path"), F.lit(target.lower()))).orderBy("path").select("path").limit(10).collect()]
        if len(part) == 1:
            return "file", part
        if part:
            return "ambiguous", [f"file:{p}" for p in part]
    exact = [r["id"] for r in index.symbols.filter(F.col("name") == target).orderBy("path", "start_line").select("id").limit(10).collect()]
    if len(exact) == 1:
        return "symbol", exact
    if exact:
        return "ambiguous", [f"symbol:{i}" for i in exact]
    hits = [r["id"] for r in lexical.search(searchable(index), target, 10).collect()]
    return ("symbol", hits) if len(hits) == 1 else ("ambiguous", [f"symbol:{i}" for i in hits]) if hits else ("none", [])


def _node(index: Index, target: str) -> tuple[DataFrame | None, Answer | None]:
    kind, ids = resolve(index, target)
    spark = index.files.sparkSession
    if kind in ("file", "symbol"):
        return spark.createDataFrame([(f"{kind}:{ids[0]}",)], "node string"), None
    return None, Answer("ambiguous" if ids else "empty", {"candidates": spark.createDataFrame([(i,) for i in ids], "candidate string")})


def snippets(rows: DataFrame, contents: DataFrame, lines: int, tokens: int) -> DataFrame:
    """Symbols (id, path, start_line, end_line) with signature, body cut to whole lines within the caps, and truncated."""
    held = rows.join(contents.select("path", F.split("content", "\n").alias("__l")), "path")
    n = F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)
    whole = F.slice("__l", F.col("start_line"), n)
    three = F.slice("__l", F.col("start_line"), F.least(F.lit(3), n))
    ends = F.filter(F.transform(three, lambda x, i: F.when(x.rlike(r"\{|=>|:\s*$"), i + 1)), lambda i: i.isNotNull())
    joined = F.array_join(F.slice(three, F.lit(1), F.coalesce(F.get(ends, 0), F.size(three))), " ")
    head = F.substring(F.trim(F.regexp_replace(F.regexp_replace(joined, r"\s*(\{|=>).*$|:\s*$", ""), r"\s+", " ")), 1, 200)
    fit = F.aggregate(F.slice(whole, F.lit(1), F.lit(max(1, lines))), F.struct(F.lit(0).cast("long").alias("cost"), F.lit(0).alias("n"), F.lit(True).alias("open")), lambda acc, x: tx.let(acc["cost"] + tx.count_tokens(x), lambda c: F.struct(F.when(acc["open"] & (c <= tokens), c).otherwise(acc["cost"]).alias("cost"), F.when(acc["open"] & (c <= tokens), acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["open"] & (c <= tokens)).alias("open"))), lambda acc: acc["n"])
    out = held.withColumns({"signature": head, "__n": fit if lines else F.lit(0), "__w": whole})
    return out.withColumns({"body": F.array_join(F.slice("__w", F.lit(1), F.col("__n")), "\n"), "truncated": F.size("__w") > F.col("__n")}).drop("__l", "__n", "__w")


def explore(index: Index, target: str, depth: int = 3, include_tests: bool = False, budget: int = 6, style: str = "balanced", relations: DataFrame | None = None) -> Answer:
    """What surrounds a file or a symbol: central symbols, relevant files, imports, callers, callees, snippets, notes."""
    kind, ids = resolve(index, target)
    if kind not in ("file", "symbol"):
        return _node(index, target)[1]
    depth, budget = _clamp(depth, 1, 5), _clamp(budget, 1, 20)
    path = ids[0] if kind == "file" else ids[0].split("#")[0]
    name = None if kind == "file" else ids[0].split("#")[1]
    own = index.symbols.filter(F.col("path") == path)
    central = own.withColumn("__t", F.when(F.col("id") == ids[0], 0).otherwise(1)).orderBy("__t", "start_line", "name").limit(depth).drop("__t")
    imports = index.imports.filter(F.col("path") == path)
    importers = index.imports.filter(F.col("resolved_path") == path).select(F.col("path").alias("p"))
    if not include_tests:
        importers = importers.filter(~tx.is_test(F.col("p")))
    spark = index.files.sparkSession
    parts = [
        spark.createDataFrame([(path, "target", 0)], "path string, reason string, ord int"),
        imports.filter("resolved_path is not null").select(F.col("resolved_path").alias("path"), F.lit("import").alias("reason"), F.lit(1).alias("ord")),
        importers.select(F.col("p").alias("path"), F.lit("importer").alias("reason"), F.lit(2).alias("ord")),
    ]
    relevant = structure.first_wins(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["path", "reason"], "ord").orderBy("ord", "path").limit(budget).drop("ord")
    calls = index.edges.filter("kind = 'calls'")
    callees = calls.filter((F.col("path") == path) & (F.lit(name is None) | (F.col("from_symbol") == name))).select("from_symbol", "target", "line")
    names = own.select("name").distinct() if name is None else spark.createDataFrame([(name,)], "name string")
    callers = calls.join(names, calls["target_name"] == names["name"], "left_semi").select("path", "from_symbol", "line", F.when(F.col("path") == path, "same_file").otherwise("cross_file").alias("scope"))
    lines, tokens, n, _, _ = STYLES[style]
    data = {"central_symbols": central, "relevant_files": relevant, "imports": imports, "callers": callers, "callees": callees, "snippets": snippets(central.limit(n), index.files, lines, tokens)}
    if relations is not None:
        data["memory_refs"] = relations.filter(((F.col("entity_kind") == "path") & (F.col("entity") == path)) | ((F.col("entity_kind") == "symbol") & F.endswith(F.col("entity"), F.lit(f"::{name}"))))
    return Answer(OK, data)


def trace(index: Index, start: str, end: str | None = None, direction: str = "forward", max_hops: int = 4) -> Answer:
    """A shortest path between two targets, or the first step from one; uncertain steps are named."""
    if direction == "backward" and end:
        start, end = end, start
    a, failed = _node(index, start)
    if failed:
        return failed
    edges = graph.materialise(graph_edges(index))
    if end is None:
        src = a.first()["node"]
        return Answer(OK, {"hops": edges.filter(F.col("src") == src).orderBy(F.desc("weight"), "dst", "relation").limit(1).select(F.lit(1).alias("hop"), "src", "dst", "relation")})
    b, failed = _node(index, end)
    if failed:
        return failed
    hops = graph.shortest_path(edges, a.first()["node"], b.first()["node"], _clamp(max_hops, 1, 6))
    doubt = hops.join(edges.filter("uncertain is not null").select("src", "dst", "relation", "uncertain", "line"), ["src", "dst", "relation"])
    nodes = hops.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    part = lambda kind: nodes.filter(F.startswith("node", F.lit(f"{kind}:"))).select(F.substring("node", len(kind) + 2, 1 << 20).alias(kind))
    return Answer(OK if not hops.isEmpty() else "empty", {"hops": hops, "files": part("file"), "symbols": part("symbol"), "uncertainty_points": doubt})


def path_of(node: F.Column) -> F.Column:
    return F.regexp_replace(F.regexp_replace(node, "^(file|symbol):", ""), "#[^#]*#[^#]*$", "")


def _impact(index: Index, seeds: DataFrame, direction: str, depth: int, include_tests: bool) -> Answer:
    which = {"dependents": "backward", "dependencies": "forward"}.get(direction, "both")
    known = graph.materialise(graph_edges(index))
    edges = graph.direction(known, which)
    rows = graph.materialise(graph.impact(edges, seeds, _clamp(depth, 1, 8), known=known).withColumn("path", path_of(F.col("node"))))
    doubt = edges.filter("uncertain is not null").join(rows.select(F.col("node").alias("dst"), "relation"), ["dst", "relation"], "left_semi")
    tests = rows.filter(tx.is_test(F.col("path"))).select("path").distinct()
    kept = rows if include_tests else rows.filter(~tx.is_test(F.col("path")))
    n = kept.agg(F.count("*").alias("n"))
    return Answer(
        OK,
        {
            "direct_affected": kept.filter("affected = 'direct'"),
            "indirect_affected": kept.filter("affected = 'indirect'"),
            "files": kept.select("path").distinct(),
            "tests": tests,
            "uncertainty_points": doubt.select(F.col("dst").alias("node"), "relation", F.col("uncertain").alias("reason")).distinct(),
            "risk_summary": n.select("n", structure.risk(F.col("n")).alias("risk")),
        },
    )


def impact(index: Index, target: str, direction: str = "both", depth: int = 3, include_tests: bool = True) -> Answer:
    seeds, failed = _node(index, target)
    return failed or _impact(index, seeds, direction, depth, include_tests)


def diff_impact(index: Index, patch: str, changed: DataFrame | None = None) -> Answer:
    """What a patch touches and what depends on it: one search from all changed files at once."""
    spark = index.files.sparkSession
    hunks = diffs.from_text(spark, patch)
    paths = hunks.select("path") if changed is None else changed.select("path").union(hunks.select("path"))
    paths = paths.distinct()
    bare = paths.join(hunks.select("path"), "path", "left_anti").select("path", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    ranges = hunks.select("path", F.col("start_line").alias("start"), F.col("end_line").alias("end")).unionByName(bare)
    touched = structure.overlapping(index.symbols.select("path", "id", "start_line", "end_line"), ranges, "path", "id", "start_line", "end_line", "start", "end")
    symbols = index.symbols.join(touched, "id", "left_semi")
    seeds = paths.join(index.files.select("path"), "path", "left_semi").select(F.concat(F.lit("file:"), "path").alias("node"))
    found = _impact(index, seeds, "dependents", 3, True)
    areas = paths.select(tx.dirname(F.col("path")).alias("area")).distinct().orderBy("area")
    n = found.data["files"].agg(F.count("*").alias("files")).join(found.data["tests"].agg(F.count("*").alias("tests")))
    risk = n.select("files", "tests", structure.risk(F.col("files") + F.col("tests"), 10, 4).alias("risk"))
    return Answer(OK, {"changed_files": paths, "changed_hunks": hunks, "changed_symbols": symbols, "affected_areas": areas, "affected_files": found.data["files"], "affected_tests": found.data["tests"], "risk_summary": risk})


def pack_context(index: Index, sources: list[str], goal: str, token_budget: int = 4000, style: str = "balanced", facts: DataFrame | None = None, handles: DataFrame | None = None) -> Answer:
    """Context for a goal within a token budget.

    A source is a handle, ``memory:`` or ``note:`` with an id, or a target to
    explore.  Segments of the best-ranked symbols come first.
    """
    spark, budget = index.files.sparkSession, _clamp(token_budget, 1, 8000)
    header = f"Objetivo: {goal}\nEstilo: {style}\nFontes: {', '.join(sources)}"
    left = budget - spark.range(1).select(tx.count_tokens(F.lit(header))).first()[0]
    if left <= 0:
        return Answer(FAILED, signals=["token_budget"])
    lines, tokens, n, depth, wide = STYLES[style]
    parts, seeds, signals = [], [], []
    for k, source in enumerate(sources):
        if source.startswith(("memory:", "note:")) and facts is not None:
            note = source.split(":", 1)[1]
            parts.append(facts.filter(F.col("id") == note).select(F.lit(k).alias("src"), F.lit(0).alias("pos"), F.lit(source).alias("ref"), F.col("path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.concat_ws("\n", "title", "text").alias("text")))
        elif source.startswith("h_") and handles is not None:
            parts.append(handles.filter(F.col("handle") == source).select(F.lit(k).alias("src"), F.lit(0).alias("pos"), F.lit(source).alias("ref"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.col("content").alias("text")))
        else:
            found = explore(index, source, depth, budget=wide, style=style)
            if "snippets" not in found.data:
                signals.append(f"E_INSUFFICIENT_EVIDENCE: {source}")
                continue
            seeds.append(resolve(index, source))
            s = found.data["snippets"]
            parts.append(s.select(F.lit(k).alias("src"), F.row_number().over(Window.orderBy("start_line", "id")).alias("pos"), F.col("id").alias("ref"), "path", "start_line", "end_line", F.concat_ws("\n", F.concat("path", F.lit(":"), F.col("start_line").cast("string")), "signature", "body").alias("text")))
    if not parts:
        return Answer(FAILED, signals=signals or ["E_INSUFFICIENT_EVIDENCE"])
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = structure.first_wins(rows, ["ref"], "src", "pos")
    if seeds:
        nodes = rows.filter("path is not null").select(F.concat(F.lit("file:"), "path").alias("node")).distinct()
        ranks = graph.pagerank(graph.neighbours(graph.materialise(graph_edges(index)), nodes), nodes)
        rows = rows.join(ranks.select(F.substring("node", 6, 1 << 20).alias("path"), "rank"), "path", "left")
    else:
        rows = rows.withColumn("rank", F.lit(0.0))
    ordered = packing.segment_costs(rows).withColumn("seq", F.row_number().over(Window.orderBy(F.desc(F.round(F.coalesce("rank", F.lit(0.0)), 9)), "src", "pos", "ref")).cast("long")).withColumn("goal", F.lit(goal))
    ordered = graph.materialise(ordered)  # a few hundred segments, read thrice
    packed = packing.budget_pack(ordered, int(left)).join(ordered.drop("goal"), "seq")
    chosen = F.when(F.col("action") == "included", F.col("text")).otherwise(packing.summarise(F.col("text"), F.col("spent")))
    body = packed.filter("action <> 'removed'").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", chosen.alias("t")))), lambda x: x["t"]), "\n\n").alias("b"), F.sum("spent").alias("cost"))
    text = body.select(F.concat(F.lit(header + "\n\n"), F.coalesce("b", F.lit(""))).alias("packed_context"), (F.lit(budget - int(left)) + F.coalesce("cost", F.lit(0))).alias("token_estimate"))
    lost = packed.filter("action <> 'included'").select("ref", "action", F.lit("budget").alias("reason"), F.lit(True).alias("recoverable"))
    full = ordered.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n").alias("content")).withColumn("handle", packing.handle_of(F.col("content")))
    refs = packed.filter("action <> 'removed'").select("ref", "path", "start_line", "end_line")
    return Answer(PARTIAL if signals else OK, {"packed_context": text, "origin_refs": refs, "removed_or_summarized": lost, "retrieve_handle": full, "all_refs": ordered.select("ref", "path", "start_line", "end_line")}, signals)


def retrieve(index: Index, handles: DataFrame, refs: DataFrame, handle: str, context_lines: int = 0) -> Answer:
    """The full content behind a handle; with context its references are read again, that many lines wider."""
    found = handles.filter(F.col("handle") == handle)
    if found.isEmpty():
        return Answer(FAILED, signals=["E_RETRIEVE_NOT_FOUND"])
    around = _clamp(context_lines, 0, 100)
    if not around:
        return Answer(OK, {"content": found.select("content")})
    own = refs.filter("path is not null").join(index.files.select("path", F.split("content", "\n").alias("__l")), "path", "left")
    first = F.greatest(F.lit(1), F.col("start_line") - around)
    wide = own.select("ref", "path", first.alias("start_line"), F.array_join(F.slice("__l", first, F.col("end_line") + around - first + 1), "\n").alias("content"))
    rank = wide.select(F.when(F.col("content").isNull(), "none").otherwise("full").alias("reversibility"))
    return Answer(OK, {"content": wide, "reversibility": packing.worst_reversibility(rank)})


def status(index: Index | None, discovered: DataFrame | None, dirty: bool = False) -> Answer:
    """Whether the index is there and fresh, how many files are pending, and coverage by language."""
    if index is None:
        return Answer(PARTIAL, signals=["E_INDEX_MISSING"])
    counted = files(index).data["files"].join(index.files.select("path", (F.size("errors") > 0).alias("has_error")), "path")
    data = {"coverage": structure.coverage(counted.withColumn("symbols", F.col("total")))}
    if discovered is None:
        return Answer(PARTIAL, data, ["STALE_UNKNOWN"])
    data["staleness"] = staleness(index.files, discovered, dirty)
    stale = data["staleness"].first()["state"] == "stale"
    return Answer(STALE if stale else OK, data, ["STALE_RUN_SYNC"] if stale else [])


def remember(facts: DataFrame, content: str, now: str, kind: str = "inbox", tags: list[str] | None = None, links: list[str] | None = None, scope: str = "project", confidence: str = "confirmed") -> tuple[DataFrame, Answer]:
    """``facts`` with a new note, the note's row, and its file's text; equal content at the same time gives the same note."""
    if kind not in notes.TYPES:
        raise ValueError(f"E_MEMORY_V2_TYPE: {kind}")
    spark = facts.sparkSession
    first = content.strip().split("\n", 1)[0].lstrip("# ")
    row = spark.range(1).select(F.concat(F.lit(f"{kind}/"), tx.slugify(F.lit(first)), F.lit("-"), F.substring(F.sha2(F.lit(now + content).cast("binary"), 256), 1, 8), F.lit(".md")).alias("path")).first()
    meta = {"title": first, "type": kind, "tags": tags or [], "links": links or [], "scope": scope, "source": "direct_capture", "confidence": confidence, "observed_at": now, "created_at": now, "updated_at": now}
    file = notes.render(meta, content)
    note = notes.normalise(notes.parse(spark.createDataFrame([(row["path"], file)], "path string, content string")))
    out = structure.apply_delta(facts, note.select(facts.columns), spark.createDataFrame([], "path string"), "path")
    status_ = note.select("id", "path", F.when(F.char_length("text") > 8000, "pending").otherwise("ready").alias("embedding_status"))
    return out, Answer(OK, {"note": status_, "file": spark.createDataFrame([(row["path"], file)], "path string, content string")})


def recall(facts: DataFrame, query: str, limit: int = 10, as_of: str | None = None, vectors: DataFrame | None = None, sources: list[str] | None = None) -> Answer:
    """Readable facts by text rank (or fused with vectors), re-ranked by confidence, recency and validity."""
    limit = _clamp(limit, 1, 50)
    wide = max(limit, 50)
    now = F.current_timestamp() if as_of is None else F.to_timestamp(F.lit(as_of))
    open_ = facts.filter(memory.readable(now, sources=sources))
    terms = lexical.query_terms(query)
    if not terms:
        return Answer(FAILED, signals=["query is empty"])
    text = open_.select("id", F.concat_ws(" ", "path", "title", "text").alias("text"))
    top = lexical.bm25(text, [[t] for t in terms], "any", "id").orderBy("rank", "id").limit(wide)
    if vectors is None:
        base = F.greatest(F.lit(1e-9), -F.col("rank")) / F.max(F.greatest(F.lit(1e-9), -F.col("rank"))).over(Window.partitionBy(F.lit(1)))  # of at most ``wide`` rows
        scored = top.select("id", base.alias("base"), F.lit("fts").alias("mechanism"))
    else:
        dense = _dense(vectors, query, wide, open_.select("id"))
        lists = [vector.ranked(dense, F.desc("score"), F.col("id")), top.select("id", (F.row_number().over(Window.orderBy("rank", "id")) - 1).alias("rank"))]
        scored = vector.rrf(lists).limit(wide).select("id", F.col("score").alias("base"), F.lit("hybrid").alias("mechanism"))
    rows = memory.with_stale_reason(open_.join(scored, "id"), now)
    ranked = memory.rank_factors(rows, F.col("base"), now).orderBy(F.desc("score"), "id").limit(limit)
    chunks = ranked.select(F.col("id").alias("note_id"), "path", "title", "type", "score", tx.excerpt(F.col("text")).alias("snippet"), "mechanism", "scope", "source", "confidence", "observed_at", "stale_reason", "contradiction_reason", "rank_reason")
    return Answer(memory.read_state(chunks).first()["state"], {"chunks": chunks})


def consolidate(facts: DataFrame, dry_run: bool = True, threshold: float = 0.92) -> Answer:
    """Suggested, applied and blocked actions of a consolidation: triage, duplicates, supersession, contradictions.

    A note is changed by one supersession at most: the one with the best score,
    then the smallest current note; its others are blocked.  ``facts`` are as the
    applied ones leave them: ``superseded_by`` and ``supersedes`` are set, and a
    triaged note lies in its folder.  A dry run applies none.
    """
    state = "sugerida" if dry_run else "aplicada"
    inbox = facts.filter("type = 'inbox'").withColumn("folder", tx.classify_note(F.col("title"), F.col("text"), F.col("tags")))
    act = lambda rows, category, state_, sources, reason, score=None: rows.select(F.lit(category).alias("category"), (F.lit(state_) if isinstance(state_, str) else state_).alias("state"), sources.alias("sources"), reason.alias("reason"), (F.lit(None).cast("double") if score is None else score).alias("score"))
    triage = act(inbox, "triagem", F.when(F.col("folder").isNull(), "bloqueada").otherwise(state), F.array("path"), F.coalesce("folder", F.lit("classificacao_indeterminada")))
    pairs = graph.materialise(memory.jaccard_pairs(facts.select("id", F.concat_ws(" ", "title", "text").alias("text")), threshold, "id"))
    relations = memory.entity_graph(facts).filter("entity_kind <> 'tag'")
    shared = memory.shared_entity_pairs(relations, "note", "entity").join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    copies = act(pairs, "duplicata", "sugerida", F.array("a", "b"), F.lit("lexical"), F.col("score")).unionByName(act(shared, "duplicata", "sugerida", F.array("a", "b"), F.concat(F.lit("entity:"), "entity")))
    found = memory.supersessions(facts, threshold)
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("score"), "current")))
    chain = first.join(first.filter("k = 1").select(F.col("origin").alias("current"), F.lit(True).alias("gone")), "current", "left")
    superseded = act(chain, "supersedencia", F.when((F.col("k") > 1) | F.coalesce("gone", F.lit(False)), "bloqueada").otherwise(state), F.array("origin", "current"), F.col("reason"), F.col("score"))
    against = act(facts.filter(memory.filled(F.col("contradiction_reason"))), "contradicao", "bloqueada", F.array("id"), F.col("contradiction_reason"))
    actions = graph.materialise(triage.unionByName(copies).unionByName(superseded).unionByName(against))
    done = actions.filter("state = 'aplicada'")
    pairs = done.filter("category = 'supersedencia'").select(F.col("sources")[0].alias("origin"), F.col("sources")[1].alias("current"))
    moved = done.filter("category = 'triagem'").select(F.col("sources")[0].alias("path"), F.col("reason").alias("__folder"))
    out = facts.join(pairs.select(F.col("origin").alias("id"), F.col("current").alias("__by")), "id", "left")
    out = out.join(pairs.groupBy(F.col("current").alias("id")).agg(F.min("origin").alias("__of")), "id", "left").join(moved, "path", "left")
    place = F.concat_ws("/", "__folder", F.substring_index("path", "/", -1))
    values = {"superseded_by": F.coalesce("__by", "superseded_by"), "supersedes": F.coalesce("__of", "supersedes"), "path": F.when(F.col("__folder").isNotNull(), place).otherwise(F.col("path"))}
    return Answer(OK, {"actions": actions, "facts": out.withColumns(values).select(facts.columns), "report": dream_report(actions, dry_run)})


def dream_report(actions: DataFrame, dry_run: bool) -> DataFrame:
    """The report's text (line_no, line): a summary, then the actions by category and by state."""
    spark = actions.sparkSession
    kinds = {"triagem": "Triagem", "duplicata": "Duplicatas", "supersedencia": "Supersedencia", "contradicao": "Contradicoes"}
    states = {"sugerida": "Acoes sugeridas", "aplicada": "Acoes aplicadas", "bloqueada": "Acoes bloqueadas"}
    counts = {(r["category"], r["state"]): r["n"] for r in actions.groupBy("category", "state").agg(F.count("*").alias("n")).collect()}  # a dozen rows at most
    total = lambda at, name: sum(n for k, n in counts.items() if k[at] == name)
    head = ["# Dream Cycle", "", f"Modo: {'dry-run' if dry_run else 'apply'}", "", "## Resumo", ""]
    head += [f"- {title}: {total(0, name)}" for name, title in kinds.items()] + [f"- {title.split()[1].capitalize()}: {total(1, name)}" for name, title in states.items()]
    quoted = F.array_join(F.transform("sources", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    line = F.concat_ws("\n", F.concat(F.lit("- **"), "category", F.lit("** ("), "state", F.lit(")")), F.concat(F.lit("  - fontes: "), quoted), F.concat(F.lit("  - motivo: "), "reason"), F.when(F.col("score").isNotNull(), F.concat(F.lit("  - score: "), F.format_string("%.3f", "score"))))
    parts = [spark.createDataFrame([(0, "", "\n".join(head))], "section int, key string, line string")]
    for k, (column, name, title) in enumerate([("category", n, t) for n, t in kinds.items()] + [("state", n, t) for n, t in states.items()], 1):
        empty = "" if total(0 if column == "category" else 1, name) else "\n\n_Nenhum item._"
        parts.append(spark.createDataFrame([(k, "", f"\n## {title}{empty}")], "section int, key string, line string"))
        parts.append(actions.filter(F.col(column) == name).select(F.lit(k).alias("section"), F.concat(F.lit("~"), F.array_join("sources", ",")).alias("key"), line.alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("section", "key", "line")


def think(facts: DataFrame, question: str, as_of: str | None = None, synthesise: Callable[[str, list[dict]], str] | None = None) -> Answer:
    """Evidence for a question, what it leaves open, and a synthesis if a callable is given for it."""
    found = recall(facts, question, 10, as_of)
    if "chunks" not in found.data:
        return found
    chunks = graph.materialise(found.data["chunks"])
    q = facts.sparkSession.createDataFrame([(0, question)], "question_id int, question string")
    data = {"citations": chunks, "unknown": memory.unmet_terms(q, facts.join(chunks.select(F.col("note_id").alias("id")), "id", "left_semi").select("title", "tags"), tags="tags"), "contradictions": chunks.filter(memory.filled(F.col("contradiction_reason"))), "stale_sources": chunks.filter(memory.filled(F.col("stale_reason")))}
    signals = []
    if synthesise is None:
        signals.append("W_SYNTHESIS_UNAVAILABLE")
    else:
        answer = synthesise(question, [r.asDict() for r in chunks.collect()])  # at most ten
        data["answer"] = facts.sparkSession.createDataFrame([(answer,)], "answer string")
    return Answer(found.state, data, signals)


def tsv(rows: DataFrame, *columns: str, limit: int = 50) -> DataFrame:
    return rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line")).limit(limit)


def payload(rows: DataFrame, pretty: bool = False) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower()}).alias("json"))
