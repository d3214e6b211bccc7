"""Column functions over text and paths."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of the tokens that the token estimate counts.
ATOM = "[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]"
# The words and patterns below decide results and are not free to change.
#: What separates words in the overlap measures.
WORD_BREAK = "[\\s,.;:!?()\"'`\\-+/\\\\_]+"
GAP_STOP_WORDS = (
    "como para com uma dos das que sobre qual quais onde quando quem este esta isso isto pelo pela "
    "what with this that these those from about their"
).split()
#: Endings of the files that a note can cite.
CITED_ENDINGS = "ts|tsx|js|jsx|mjs|cjs|py|dart|kt|kts|java|go|rs|md|json|yaml|yml"
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyw": "python", ".go": "go", ".java": "java", ".rs": "rust",
    ".kt": "kotlin", ".kts": "kotlin", ".dart": "dart", ".cs": "csharp", ".csx": "csharp",
}
#: Among them this library's own folder of state.
IGNORED_FOLDERS = ["node_modules", ".pnpm-store", ".git", ".skarn", "dist", "build", ".next", "coverage"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def half_up(x: Column, digits: int = 4) -> Column:
    """Rounding with halves upwards, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without diacritics, in order."""
    return F.regexp_extract_all(F.lower(fold_marks(text)), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def _marked() -> tuple[str, str]:
    """Letters that decompose into a Latin letter and marks, and those letters; the marks stand at the end of the first."""
    found = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    bare = {c: d[0] for c, d in found.items() if len(d) > 1 and d[0].isascii()}
    return "".join(bare) + "".join(map(chr, range(0x300, 0x370))), "".join(bare.values())


MARKED, BARE = _marked()


def fold_marks(text: Column) -> Column:
    """Latin letters without their diacritics, so that accents don't tell words apart; combining marks go."""
    return F.when(text.rlike("[^\\x00-\\x7f]"), F.translate(text, MARKED, BARE)).otherwise(text)


def fold_word(word: str) -> str:
    """The same of a query's word."""
    return word.translate({**dict(zip(map(ord, MARKED), BARE)), **dict.fromkeys(range(0x300, 0x370))})


def word_set(text: Column, shortest: int = 3) -> Column:
    """The different lower-case words of at least ``shortest`` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: F.char_length(w) >= shortest))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def gap_terms(query: Column) -> Column:
    """Words of a question that an answer ought to mention."""
    return F.filter(word_set(query, 4), lambda w: ~w.isin(GAP_STOP_WORDS))


def count_tokens(text: Column) -> Column:
    """Estimate of subword tokens: letters split at case changes and every six, a number or sign is one."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    atoms = F.regexp_extract_all(spaced, F.lit(ATOM), F.lit(0))
    cost = lambda a: F.when(a.rlike("^[A-Za-z]"), F.ceil(F.char_length(a) / 6)).otherwise(F.lit(1).cast("long"))
    return F.aggregate(atoms, F.lit(0).cast("long"), lambda acc, a: acc + cost(a))


def slugify(text: Column, longest: int = 50) -> Column:
    plain = F.regexp_replace(F.lower(fold_marks(text)), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, longest)
    return F.when(cut == "", F.lit("nota")).otherwise(cut)


#: White space but for the line feed, as the compaction sees it.
_BLANK = "[\\t\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def compact_text(text: Column) -> Column:
    """Lines without a leading ``12:`` (or tab), without space around them, no two blank ones in a row, none at the ends."""
    out = F.regexp_replace(text, f"(?dm)^{_BLANK}*[0-9]+[:\\t]", "")
    out = F.regexp_replace(out, f"(?dm)^{_BLANK}+|{_BLANK}+$", "")
    return F.regexp_replace(F.regexp_replace(out, "\\n{3,}", "\n\n"), "^\\n+|\\n+\\z", "")


def chunk_text(path: Column, name: Column, kind: Column, body: Column, longest: int = 2000) -> Column:
    """What is embedded for a symbol: its head, and its body on the next line if it has one."""
    return F.substring(F.concat_ws("\n", F.concat_ws(" ", path, name, kind), F.nullif(body, F.lit(""))), 1, longest)


def excerpt(text: Column, longest: int = 240) -> Column:
    return F.substring(text, 1, longest)


def target_name(target: Column) -> Column:
    """The last part of a dotted or ``::`` name; the name itself if it has none."""
    parts = F.filter(F.split(target, "[.:]"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), target)


def language_of(path: Column) -> Column:
    ext = F.regexp_extract(F.lower(path), "(\\.[^./]*)$", 1)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("unsupported"))


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.lit(IGNORED_FOLDERS)) | path.rlike("\\.min\\.js$|\\.map$")


def is_test(path: Column) -> Column:
    return path.rlike("(^|/)(test|tests|__tests__)/|\\.test\\.")


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/", 1)


def match_reason(query: str, name: Column, path: Column, kind: Column) -> Column:
    """Why a candidate matched, the strongest reason first."""
    q = query.strip().lower()
    return (
        F.when(F.lower(name) == q, "name_exact")
        .when(F.startswith(F.lower(name), F.lit(q)), "name_prefix")
        .when(F.contains(F.lower(name), F.lit(q)), "name_token")
        .when(F.contains(F.lower(path), F.lit(q)), "path_token")
        .when(F.contains(F.lower(kind), F.lit(q)), "kind_token")
        .otherwise("fts_match")
    )


REASON_WEIGHT = {"name_exact": 1.0, "name_prefix": 0.9, "name_token": 0.8, "path_token": 0.65, "kind_token": 0.5, "fts_match": 0.4}


def candidate_score(reason: Column, rank: Column, path: Column) -> Column:
    """Weight of the reason, a little for the text rank (negative is better), less for deep paths."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REASON_WEIGHT.items() for x in kv]), reason), F.lit(0.3))
    boost = F.least(F.lit(0.09), F.greatest(F.lit(0.0), -rank / 100.0))
    depth = F.least(F.lit(0.08), F.lit(0.005) * F.size(F.split(path, "/")))
    return half_up(F.greatest(F.lit(0.0), weight + boost - depth))


def classify_note(title: Column, body: Column, tags: Column) -> Column:
    """Folder that a note belongs in by its tags and wording, else null."""
    text = F.lower(F.concat_ws(" ", title, body))
    has = lambda tag: F.array_contains(tags, tag) | F.array_contains(tags, f"#{tag}")
    says = lambda *words: F.lit(False) if not words else text.rlike("|".join(words))
    return (
        F.when(has("meeting") | says("ata"), "meetings")
        .when(has("adr") | says("decisão", "decisao"), "decisions")
        .when(has("project"), "projects")
        .when(has("entity"), "entities")
        .when(has("reference") | says("referência", "referencia"), "references")
    )


def note_id(path: Column, content: Column) -> Column:
    """Sixteen hex digits that tell a file of this path and content from all others."""
    return F.substring(F.sha2(F.concat(path, F.lit("\n"), content).cast("binary"), 256), 1, 16)


def wikilinks(text: Column) -> Column:
    """Targets of [[target]] and [[target|label]]."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]"), F.lit(1)))


def cited_paths(text: Column) -> Column:
    """Paths of known endings after white space, a quote or a bracket, without leading ./ and doubled slashes."""
    found = F.regexp_extract_all(text, F.lit(f"(?:^|[\\s`'\"(])([a-zA-Z0-9_@./-]+\\.(?:{CITED_ENDINGS}))\\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(F.regexp_replace(p, "^\\./+", ""), "/+", "/")))


def code_mentions(text: Column) -> Column:
    """Names of two letters or more between backticks."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("`([A-Za-z_][A-Za-z0-9_]+)`"), F.lit(1)))


def _letters(text: Column) -> Column:
    return F.split(text, "")


def first_gram(term: Column, n: int = 4) -> Column:
    return let(_letters(term), lambda c: F.array_join(F.slice(c, 1, n), ""))


def grams(text: Column, n: int = 4) -> Column:
    """The different runs of ``n`` characters: whatever a text contains has its first gram among them."""
    return let(_letters(text), lambda c: F.array_distinct(F.transform(c, lambda x, i: F.concat_ws("", x, *[F.get(c, i + k) for k in range(1, n)]))))
