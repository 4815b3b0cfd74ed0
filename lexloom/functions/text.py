"""Column functions over texts, ids and small arrays (cleaning, tokens, article ids, scores, routing)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that lexical tokens leave out (fixed values).
STOP_WORDS = (
    "le", "la", "les", "de", "du", "des", "un", "une", "et", "ou", "en", "au", "aux", "par", "pour", "dans",
    "sur", "que", "qui", "qu", "est", "sont", "ce", "cette", "ses", "son", "sa", "their", "the", "a",
)
#: Dates in a page footer, and letters that may stand at a broken word (fixed patterns).
_MODIFIED = r"Dernière modification le (\d{1,2} \S+ \d{4})"
_GENERATED = r"Document généré le (\d{1,2} \S+ \d{4})"
_LETTER = "[a-zàâäéèêëïîôùûüç]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _normalized(form: str, drop_marks: bool):
    """Unicode normalisation, which Spark has no function for, as one vectorized helper."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            t = unicodedata.normalize(form, t)
            return "".join(c for c in t if unicodedata.category(c)[0] != "M") if drop_marks else t

        return texts.map(one)

    return run


def _unless_ascii(col: Column, helper) -> Column:
    """Texts of ASCII letters are normalised already and stay out of Python."""
    return F.when(col.rlike(r"^[\x00-\x7F]*$"), col).otherwise(helper(col))


# --- cleaning


def footer_regex(code_name: Column | str) -> Column:
    """Pattern of the footer that names a code: its name, quoted, and two dates."""
    return F.concat(F.lit(r"\Q"), _c(code_name), F.lit(r"\E\s*-\s*Dernière modification le \d{1,2} \S+ \d{4} - Document généré le \d{1,2} \S+ \d{4}\n?"))


def fix_hyphenation(col: Column | str) -> Column:
    """Join words that a hyphen breaks over two lines."""
    return F.regexp_replace(_c(col), f"(?iu)({_LETTER})-\n({_LETTER})", "$1$2")


def clean_page_text(col: Column | str, footer: Column) -> Column:
    """Form feeds as newlines, NFC, no footer, no-break spaces as spaces, no blanks at line ends, no broken words."""
    text = F.replace(_c(col), F.lit("\f"), F.lit("\n"))
    text = _unless_ascii(text, _normalized("NFC", False))
    text = F.regexp_replace(text, footer, F.lit(""))
    text = F.translate(text, "  ", "  ")
    return fix_hyphenation(F.regexp_replace(text, r"(?m)[^\S\n]+$", ""))


def has_replacement_character(col: Column | str) -> Column:
    return _c(col).contains("�")


def is_blank_page(col: Column | str, min_chars: int = 10) -> Column:
    return F.length(F.regexp_replace(_c(col), r"\s", "")) < min_chars


def has_footer_pollution(col: Column | str, code_name: Column | str | None = None) -> Column:
    found = _c(col).rlike(_MODIFIED)
    return found if code_name is None else found | F.coalesce(_c(col).contains(F.concat(_c(code_name), F.lit(" - Derni"))), F.lit(False))


def footer_dates(pages: DataFrame) -> DataFrame:
    """(corpus_id, last_modified, generated_at): the dates of each corpus' first page that has them."""
    both = _MODIFIED + ".*" + _GENERATED
    found = pages.select("corpus_id", "page_no", F.regexp_extract("text", both, 1).alias("m"), F.regexp_extract("text", both, 2).alias("g")).where("m <> ''")
    return found.groupBy("corpus_id").agg(F.min_by("m", "page_no").alias("last_modified"), F.min_by("g", "page_no").alias("generated_at"))


# --- article lines


def is_editorial_line(col: Column | str) -> Column:
    """Index lines that look like articles but cite an ordinance, law or decree."""
    t = F.trim(_c(col))
    body = F.trim(F.substring(t, 9, 1_000_000))
    cites = body.rlike(r"^[LRDA]\.\s+\d") & body.rlike(r"(?i)(?:ordonnance|loi n°|Décret|décret)")
    return t.startswith("Article ") & ~t.rlike(r"(?i)^Article liminaire\s*$") & ~t.rlike("(?i)^Article Annexe") & (cites | body.rlike(r"(?i)\d[\d.-]*\s+(?:l'ordonnance|la loi|le décret)"))


#: Article lines: pattern of the number, kind; the first that matches counts (fixed values).
ARTICLE_PATTERNS = (
    (r"(?iu)^Article (Annexe à l'article .+)$", "annexe"),
    (r"(?i)^Article (Annexe [IVXLC\d-]+)$", "annexe"),
    (r"(?i)^Article (R\*[\d-]+(?:-\d+)*)$", "abrogated"),
    (r"(?i)^Article (A\d+(?:-\d+)*)$", "standard"),
    (r"(?i)^Article ([LRDA]\*?\d+(?:-\d+)*(?: [A-Z]|-[A-Z])*)$", "standard"),
    (r"(?i)^Article (L\d{1,2})$", "standard"),
    (r"^Article ((?:[RD]?\d+(?:-\d+)+(?: [A-Z])?))$", "standard"),
    (r"^Article (\d+(?:-\d+)*)$", "standard"),
)
STRICT_ARTICLE = r"^Article ((?:[RD]?\d+(?:-\d+)+(?: [A-Z])?))\s*$"
#: Heading lines by level (fixed patterns).
HEADINGS = {
    "partie": r"(?i)^Partie (?:législative(?:\s+nouvelle)?|réglementaire)",
    "livre": "(?i)^Livre ",
    "titre": "(?i)^Titre ",
    "chapitre": "(?i)^Chapitre ",
    "section": r"(?i)^Section \d+",
}


def match_article_line(col: Column | str, strict: bool = True) -> Column:
    """struct(raw_number, kind) of an article line, null for another line."""
    t = F.trim(_c(col))

    def hit(pattern: str, kind: str) -> Column:
        return F.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, 1).alias("raw_number"), F.lit(kind).alias("kind")))

    if strict:
        return hit(STRICT_ARTICLE, "standard")
    liminary = F.when(t.rlike(r"(?i)^Article liminaire\s*$"), F.struct(F.lit("liminaire").alias("raw_number"), F.lit("liminaire").alias("kind")))
    return F.when(t.startswith("Article ") & ~is_editorial_line(t), F.coalesce(liminary, *[hit(p, k) for p, k in ARTICLE_PATTERNS]))


def heading_level(col: Column | str) -> Column:
    """partie, livre, titre, chapitre or section of a heading line, null for another line."""
    t = F.trim(_c(col))
    return F.coalesce(*[F.when(t.rlike(p), F.lit(level)) for level, p in HEADINGS.items()])


def normalize_article_id(raw: Column | str, kind: Column | str) -> Column:
    """Article ids in one spelling, by kind."""
    t = F.trim(_c(raw))
    quoted = F.translate(t, "‘’", "''")
    cited = r"(?iu)^Annexe à l'article ([A-Z])\.\s*([\d-]+)"
    short = r"(?i)^Annexe ([IVXLC\d-]+)$"
    free = F.regexp_replace(F.regexp_replace(F.replace(F.regexp_replace(quoted, "(?iu)^Annexe à l'article ", "annexe-"), F.lit("."), F.lit("")), r"\s+", "-"), "(?i)du-code-de-la-consommation$", "")
    annex = (
        F.when(quoted.rlike(cited), F.concat(F.lit("annexe-"), F.upper(F.regexp_extract(quoted, cited, 1)), F.regexp_extract(quoted, cited, 2)))
        .when(quoted.rlike(short), F.concat(F.lit("Annexe "), F.regexp_extract(quoted, short, 1)))
        .otherwise(F.regexp_replace(free, "-+$", ""))
    )
    plain = F.regexp_replace(F.regexp_replace(t, r"(\d) ([A-Z])$", "$1-$2"), r"\s+", "")
    k = _c(kind)
    return F.when(k == "liminaire", F.lit("liminaire")).when(k == "annexe", annex).when(k == "abrogated", F.regexp_replace(t, r"\s+", "")).otherwise(plain)


def article_format(col: Column | str) -> Column:
    """Class of an article number's format."""
    t = _c(col)
    rules = (
        ("(?i)^annexe", "annexe"), ("^liminaire$", "liminaire"), (r"^R\*", "R-star"), (r"^R\d", "R-prefix"), (r"^D\d", "D-prefix"), (r"^L\d", "L-prefix"),
        (r"^A\d", "A-prefix"), (r"[ -][A-Z]$", "alpha-suffix"), (r"^\d+(-\d+)+$", "numeric-dash"), (r"^\d+$", "numeric"),
    )
    out = None
    for pattern, name in rules:
        out = (F if out is None else out).when(t.rlike(pattern), name)
    return out.otherwise("other")


def article_prefix(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), "-[^-]*$", "")


def shared_numeric_prefix(a: Column | str, b: Column | str) -> Column:
    x, y = (F.regexp_extract(_c(v), r"^L?\d+", 0) for v in (a, b))
    return (x == y) & (x != "")


def are_neighbors(a: Column | str, b: Column | str, same_corpus: Column | bool = True) -> Column:
    """Articles of one corpus and prefix that are not the same."""
    same = same_corpus if isinstance(same_corpus, Column) else F.lit(same_corpus)
    return same & (_c(a) != _c(b)) & (article_prefix(a) == article_prefix(b))


# --- tokens


def fold_text(col: Column | str) -> Column:
    """Lower case without accents."""
    return F.lower(_unless_ascii(_c(col), _normalized("NFD", True)))


def lexical_tokens(col: Column | str, folded: bool = False) -> Column:
    """Words of two characters or more that are no stop words, in order, repeats kept."""
    found = F.regexp_extract_all(_c(col) if folded else fold_text(col), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}-]*"), 0)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def normalize_question(col: Column | str) -> Column:
    """A question's folded text with single spaces for punctuation and white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold_text(F.trim(_c(col))), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def overlap_count(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(_c(a), _c(b)))


def jaccard(a: Column | str, b: Column | str, empty_value: float = 0.0) -> Column:
    """Shared share of two token sets; `empty_value` if both are empty."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(float(empty_value))).otherwise(overlap_count(a, b) / union)


def shared_tokens(a: Column | str, b: Column | str, limit: int = 8) -> Column:
    return F.slice(F.sort_array(F.array_intersect(_c(a), _c(b))), 1, limit)


def count_tokens(col: Column | str, tokenizer: str | None = None) -> Column:
    """Tokens of a text: words and marks by a pattern, or those of a tokenizer file (one instance a worker)."""
    if tokenizer is None:
        return F.size(F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), 0))

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        own = _tokenizer(tokenizer)
        return pd.Series([len(e.ids) for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)])

    return count(_c(col))


_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


# --- ids, scores, routing


def chunk_id(article: Column | str, index: Column | str) -> Column:
    return F.concat_ws("#", _c(article), _c(index).cast("string"))


def chars_per_token(chars: Column | str, tokens: Column | str) -> Column:
    return F.when(_c(tokens) > 0, F.round(_c(chars) / _c(tokens), 4)).otherwise(F.lit(0.0))


def relative_score(score: Column | str, best: Column | str) -> Column:
    """Score over the best one; where the best isn't positive, 1 for the best and 0 for others."""
    s, b = _c(score), _c(best)
    return F.when(b <= 0, (s == b).cast("double")).otherwise(s / b)


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 of the JSON of the parts, in order."""
    return F.sha2(F.to_json(F.struct(*[_c(p) for p in parts])), 256)


def mentioned_near(text: Column | str, article: Column | str, keywords: Column, window: int = 120) -> Column:
    """Whether a keyword stands within `window` characters of the article's first mention."""
    at = F.locate_expr(article, text) if hasattr(F, "locate_expr") else F.position(_c(article), _c(text))
    near = F.lower(F.substring(_c(text), F.greatest(at - window, F.lit(1)), F.length(_c(article)) + 2 * window))
    return (at > 0) & F.exists(keywords, lambda k: near.contains(F.lower(k)))


def clean_routing(predicted: Column | str, known: Column) -> Column:
    """Predicted corpora in order, once each; null if one isn't known."""
    return F.when(F.forall(_c(predicted), lambda x: F.array_contains(known, x)), F.array_distinct(_c(predicted)))


def routing_decision(predicted: Column | str, explicit: Column | str | None = None) -> Column:
    """struct(decision, corpora): explicit corpora if given (an empty list searches all), else the predicted
    ones; nothing predicted abstains."""
    p = F.coalesce(_c(predicted), F.array().cast("array<string>"))

    def row(decision: str, corpora: Column) -> Column:
        return F.struct(F.lit(decision).alias("decision"), corpora.alias("corpora"))

    routed = F.when(F.size(p) > 0, row("routed", p)).otherwise(row("abstain", p))
    if explicit is None:
        return routed
    e = _c(explicit)
    return F.when(e.isNull(), routed).when(F.size(e) > 0, row("routed", F.array_distinct(e))).otherwise(row("global", e))


JUDGE = "correctness INT, completeness INT, groundedness INT, abstention_correct BOOLEAN, explanation STRING"


def parse_judge(col: Column | str, schema: str = JUDGE, scores: tuple[str, ...] = ("correctness", "completeness", "groundedness"), flags: tuple[str, ...] = ("abstention_correct",), texts: tuple[str, ...] = ("explanation",)) -> Column:
    """struct(judge, error): the parsed answer, and what is wrong with it (null if nothing)."""
    j = F.from_json(_c(col), schema)
    error = F.when(j.isNull() | F.get_json_object(_c(col), "$").isNull(), "invalid_json")
    for s in scores:
        error = error.when(j[s].isNull() | ~j[s].between(0, 4), f"bad_{s}")
    for f in flags:
        error = error.when(j[f].isNull(), f"bad_{f}")
    for t in texts:
        error = error.when(j[t].isNull() | (F.trim(j[t]) == ""), f"bad_{t}")
    return F.struct(j.alias("judge"), error.alias("error"))


_HEADER = r"\[Source (\d+) — (.+?) — Article (.+?) — chunk (\d+)\]"


def parse_context(df: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each source block of a context: source_id, code_name, article_number, chunk_index, content."""
    block = F.explode(F.split(F.col(col), r"(?=\[Source \d+ — )")).alias("block")
    found = df.select(*keep, block).where(F.col("block").rlike("^" + _HEADER))
    group = [F.regexp_extract("block", "^" + _HEADER, i) for i in range(1, 5)]
    body = F.trim(F.regexp_replace("block", "^" + _HEADER + r"\n?", ""))
    return found.select(*keep, group[0].cast("int").alias("source_id"), group[1].alias("code_name"), group[2].alias("article_number"), group[3].cast("int").alias("chunk_index"), F.regexp_replace(body, r"\s+$", "").alias("content"))
