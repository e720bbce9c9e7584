"""Chunkers and the embedder: fixed windows, sections of passages, sentences, source code.

Fixed windows, sentences and passages are Column expressions; code is parsed, so a Python
function runs on one file at a time (``mapInPandas``). The tokenizer is a parameter throughout.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import let, passage_text, tokens, trim_all
from lodestone.functions.vector import l2_normalize
from lodestone.sources.places import shared_folder

# Sections of articles that are not chunked, folders that hold no sources.
SKIP_SECTIONS = frozenset({"AUTH_CONT", "SUPPL", "REF", "COMP_INT"})
IGNORED_FOLDERS = [".venv", "__pycache__", ".git", ".model_cache", ".ruff_cache", ".pytest_cache", "node_modules", ".mypy_cache", "htmlcov", ".benchmarks", ".cache_ggshield"]


def words(text: str) -> list[str]:
    return text.split()


def _check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")


def fixed_windows(docs: DataFrame, size: int = 512, overlap: int = 64, text: str = "text", tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """Sliding windows of tokens: ``chunk_index``, ``chunk_text``, ``chunk_tokens`` beside the other columns.

    The stride is size less overlap; the last window is the first that reaches the end;
    texts without tokens give none.
    """
    _check(size, overlap)
    stride = size - overlap
    t = docs.withColumn("_t", tokenizer(F.col(text))).where(F.size("_t") > 0)
    last = F.greatest(F.ceil((F.size("_t") - size) / stride), F.lit(0)).cast("int")
    cut = t.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
    part = F.slice("_t", F.col("chunk_index") * stride + 1, F.lit(size))
    return cut.withColumn("_part", part).withColumn("chunk_text", F.array_join("_part", " ")).withColumn("chunk_tokens", F.size("_part")).drop("_t", "_part", text)


def sweep(docs: DataFrame, configs: list[tuple[int, int]], text: str = "text") -> DataFrame:
    """Fixed windows of several (size, overlap) in one pass over the corpus; adds ``size`` and ``overlap``."""
    for size, overlap in configs:
        _check(size, overlap)
    grid = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in configs])
    t = docs.withColumn("_t", tokens(F.col(text))).where(F.size("_t") > 0).drop(text).withColumn("_g", F.explode(grid)).select("*", "_g.size", "_g.overlap").drop("_g")
    stride = F.col("size") - F.col("overlap")
    last = F.greatest(F.ceil((F.size("_t") - F.col("size")) / stride), F.lit(0)).cast("int")
    cut = t.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last))).withColumn("_part", F.slice("_t", F.col("chunk_index") * stride + 1, F.col("size")))
    return cut.withColumn("chunk_text", F.array_join("_part", " ")).withColumn("chunk_tokens", F.size("_part")).drop("_t", "_part")


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """One chunk for each sentence: cut at white space behind ``.``, ``!`` or ``?``."""
    marked = F.regexp_replace(F.col(text), r"([.!?])\s+", "$1\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda x: F.trim(x) != "")
    cut = docs.withColumn("_s", parts).select("*", F.posexplode("_s").alias("chunk_index", "chunk_text")).drop("_s", text)
    return cut.withColumn("chunk_tokens", F.size(tokens(F.col("chunk_text"))))


def chunk_passages(
    articles: DataFrame,
    size: int = 512,
    overlap: int = 0,
    respect_sections: bool = True,
    skip: frozenset[str] = SKIP_SECTIONS,
    tokenizer: Callable[[Column], Column] = tokens,
) -> DataFrame:
    """Section-aware chunks of articles; passages are never split.

    ``articles``: ``doc_title``, ``doc_url`` and ``passages``, array<struct<section, kind, text>>.
    A fold over the passages of an article holds the open chunk and its tokens. A chunk is
    closed where the section changes (if these are respected) and before a passage that would
    make it longer than ``size``; its last ``overlap`` tokens begin the next one. A passage longer than
    that is a chunk by itself. Passages of the front, of skipped sections and blank ones don't count.
    """
    _check(size, overlap)
    skipped = F.array(*map(F.lit, sorted(skip))) if skip else F.array().cast("array<string>")
    shown = lambda p: F.struct(F.coalesce(p["section"], F.lit("")).alias("section"), F.coalesce(p["kind"], F.lit("")).alias("kind"), trim_all(F.coalesce(p["text"], F.lit(""))).alias("text"))
    counts = lambda p: (p["kind"] != "front") & ~F.array_contains(skipped, p["section"]) & (p["text"] != "")
    costed = lambda p: let(passage_text(p["text"], p["kind"]), lambda t: F.struct(p["section"].alias("section"), t.alias("text"), F.size(tokenizer(t)).alias("cost")))
    listed = F.transform(F.filter(F.transform(F.coalesce("passages", F.array().cast("array<struct<section: string, kind: string, text: string>>")), shown), counts), costed)
    # the open chunk is a list of texts, so that no text is copied until it closes
    state = "struct<out: array<struct<text: string, n: int, section: string>>, held: array<string>, count: int, section: string>"
    zero = F.from_json(F.lit('{"out": [], "held": [], "count": 0}'), state)

    def closed(s: Column, when: Column) -> Column:
        """The state with the open chunk closed if ``when`` holds and there is one."""

        def cut_off(whole: Column, cut: Column) -> Column:
            done = F.struct(whole.alias("text"), F.size(cut).alias("n"), F.coalesce(s["section"], F.lit("")).alias("section"))
            tail = F.array_join(F.slice(cut, F.greatest(F.size(cut) - overlap, F.lit(0)) + 1, F.lit(overlap)), " ") if overlap else F.lit("")
            rest = lambda t: F.when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))
            return let(tail, lambda t: F.struct(F.array_append(s["out"], done).alias("out"), rest(t).alias("held"), F.size(tokenizer(t)).alias("count"), s["section"].alias("section")))

        # texts are joined and cut into tokens once a chunk
        new = let(F.array_join(s["held"], "\n"), lambda whole: let(tokenizer(whole), lambda cut: cut_off(whole, cut)))
        return F.when(when & (F.size(s["held"]) > 0), new).otherwise(s)

    def step(s: Column, p: Column) -> Column:
        changed = ~p["section"].eqNullSafe(s["section"])
        held = lambda s: F.struct(F.array_append(s["held"], p["text"]).alias("held"), (s["count"] + p["cost"]).alias("count"))
        first = let(closed(s, changed) if respect_sections else s, lambda s: F.struct(s["out"].alias("out"), s["held"].alias("held"), s["count"].alias("count"), p["section"].alias("section")))
        second = let(first, lambda s: closed(s, s["count"] + p["cost"] > size))
        return let(second, lambda s: F.struct(s["out"].alias("out"), held(s)["held"].alias("held"), held(s)["count"].alias("count"), s["section"].alias("section")))

    chunks = F.aggregate(listed, zero, step, lambda s: closed(s, F.lit(True))["out"])
    # exploded where it is worked out: of a column with a name, Spark first asks whether it is null or empty, and folds again for that
    cut = articles.select("doc_title", "doc_url", F.posexplode(chunks).alias("chunk_index", "c"))
    return cut.select("doc_title", "doc_url", F.col("c.section").alias("doc_section"), "chunk_index", F.col("c.text").alias("chunk_text"), F.col("c.n").alias("chunk_tokens"))


def split_lines(text: str, budget: int, tokenize: Callable[[str], list[str]]) -> list[str]:
    """Runs of lines within a budget (64 tokens at least); a longer line stands alone."""
    budget = max(budget, 64)
    out, held, count = [], [], 0
    for line in text.splitlines():
        cost = len(tokenize(line))
        if held and count + cost > budget:
            out.append("\n".join(held))
            held, count = [], 0
        held.append(line)
        count += cost
    if held:
        out.append("\n".join(held))
    return [x for x in out if x.strip()]


def code_chunks(source: str, path: str, size: int = 512, least: int = 50, tokenize: Callable[[str], list[str]] = words) -> list[str]:
    """Chunks along the syntax tree, each under a header with its file and scope, which counts towards ``size``.

    Statements that fit are packed together; one that doesn't is opened and its body cut the
    same way; what can't be opened, or parsed, is cut by lines. Chunks under ``least`` tokens join
    their neighbour where both together fit. Only lines that are longer by themselves, and pieces
    of up to 64 tokens where the header leaves less room, make a chunk longer than ``size``.
    """
    lines = source.splitlines()

    def shown(scope: tuple[str, ...], text: str) -> str:
        return f"# File: {path}" + (f"\n# Scope: {' > '.join(scope)}" if scope else "") + f"\n{text}"

    def cost(scope: tuple[str, ...], text: str) -> int:
        return len(tokenize(shown(scope, text)))

    def begin(node: ast.stmt) -> int:
        return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1

    pieces: list[tuple[tuple[str, ...], str]] = []

    def put(scope: tuple[str, ...], own: list[str]) -> None:
        text = "\n".join(own)
        if not text.strip():
            return
        if cost(scope, text) <= size:
            pieces.append((scope, text))
        else:
            pieces.extend((scope, x) for x in split_lines(text, size - cost(scope, ""), tokenize))

    def cut(nodes: list[ast.stmt], first: int, last: int, scope: tuple[str, ...]) -> None:
        held: list[str] = []
        at = first
        for k, node in enumerate(nodes):
            end = begin(nodes[k + 1]) if k + 1 < len(nodes) else last
            end = max(end, node.end_lineno or node.lineno)
            own = lines[at:end]
            body = getattr(node, "body", None)
            if held and cost(scope, "\n".join([*held, *own])) > size:
                put(scope, held)
                held = []
            if cost(scope, "\n".join(own)) > size and isinstance(body, list) and body and isinstance(body[0], ast.stmt):
                start = min(map(begin, body))
                put(scope, lines[at:start])
                cut(body, start, end, (*scope, node.name) if hasattr(node, "name") else scope)
            else:
                held += own
            at = end
        put(scope, held)

    try:
        tree = ast.parse(source)
        cut(tree.body, 0, len(lines), ()) if tree.body else put((), lines)
    except (SyntaxError, ValueError):
        put((), lines)
    return [shown(scope, text) for scope, text in merge_small(pieces, least, size, cost)]


def merge_small(pieces: list[tuple[tuple[str, ...], str]], least: int, size: int, cost: Callable[[tuple[str, ...], str], int]) -> list[tuple[tuple[str, ...], str]]:
    """Pieces under ``least`` tokens go to the next piece, or to the one before it, and take that one's scope; none grows beyond ``size``."""
    out, k = list(pieces), 0
    while k < len(out):
        scope, text = out[k]
        if cost(scope, text) < least:
            after = out[k + 1] if k + 1 < len(out) else None
            before = out[k - 1] if k else None
            if after and cost(after[0], f"{text}\n{after[1]}") <= size:
                out[k : k + 2] = [(after[0], f"{text}\n{after[1]}")]
                continue
            if before and cost(before[0], f"{before[1]}\n{text}") <= size:
                out[k - 1 : k + 1] = [(before[0], f"{before[1]}\n{text}")]
                continue
        k += 1
    return out


def chunk_code(files: DataFrame, size: int = 512, least: int = 50, tokenize: Callable[[str], list[str]] = words) -> DataFrame:
    """Code chunks of ``path``, ``text`` with ``file_index`` within each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, k, c, len(tokenize(c))) for p, t in zip(batch["path"], batch["text"], strict=True) for k, c in enumerate(code_chunks(t or "", p, size, least, tokenize))]
            yield pd.DataFrame(rows, columns=["path", "file_index", "chunk_text", "chunk_tokens"])

    return files.select("path", "text").mapInPandas(run, "path string, file_index int, chunk_text string, chunk_tokens int")


def global_index(chunks: DataFrame) -> DataFrame:
    """Add ``chunk_index``, counted over all files in the order of their paths.

    Counts per file are dealt to ranges of paths; a range's files are summed up in it, and the
    ranges themselves, one row each, before it. Chunks stay where they are but for one join.
    """
    spark, folder = chunks.sparkSession, shared_folder(chunks.sparkSession, "paths")
    sizes = chunks.groupBy("path").agg(F.count("*").alias("n"))
    sizes.repartitionByRange("path").withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # a row a partition
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_earlier"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("path")) - F.col("n")
    before = sizes.withColumn("_within", within).join(F.broadcast(parts), "part").select("path", (F.col("_within") + F.col("_earlier")).alias("_before"))
    return chunks.join(before, "path").withColumn("chunk_index", (F.col("_before") + F.col("file_index")).cast("int")).drop("_before")


def hash_embedding(text: Column, dimension: int = 16, prefix: str = "") -> Column:
    """A deterministic embedding: words counted by a bucket of their md5, scaled to length 1."""
    words_of = tokens(F.lower(F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))))
    bucket = F.transform(words_of, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dimension)))

    def count(k: int) -> Column:
        return F.size(F.filter(bucket, lambda b: b == k)).cast("double")

    return l2_normalize(F.array(*[count(k) for k in range(dimension)]))


def embed(chunks: DataFrame, text: str, out: str, model: Callable[[list[str]], list[list[float]]], batch: int = 32, prefix: str = "", retries: int = 3) -> DataFrame:
    """Embed by a function of texts, ``batch`` at a time, in order; failures are tried again with growing pauses."""
    import time

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in chunks.schema.fields if f.name != out)}, `{out}` array<double>"

    def call(texts: list[str]) -> list[list[float]]:
        for attempt in range(retries + 1):
            try:
                return model(texts)
            except (TimeoutError, ConnectionError):
                if attempt == retries:
                    raise
                time.sleep(2**attempt)
        raise AssertionError

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = [prefix + (t or "") for t in frame[text]]
            vectors = [v for s in range(0, len(texts), batch) for v in call(texts[s : s + batch])]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(texts)} texts but {len(vectors)} vectors")
            yield frame.drop(columns=[out], errors="ignore").assign(**{out: vectors})

    return chunks.mapInPandas(run, schema)
