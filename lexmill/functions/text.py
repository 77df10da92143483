"""Text normalisation and description as Column expressions. Null and blank are alike unless a function says otherwise."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fillers that don't count as words, and typographic quotes with their plain forms.
HESITATIONS = ("um", "uh", "ah", "hmm")
QUOTES = ("‘’‚‛“”„‟", "''''\"\"\"\"")
VOWEL_RUN = "[aeiouy]+"
WORD = "[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    return F.coalesce(F.trim(_col(c)) == "", F.lit(True))


def squeeze(c: Column | str) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def plain(c: Column | str) -> Column:
    """Everything but ASCII letters, digits, apostrophes and white space becomes a space."""
    return F.regexp_replace(_col(c), r"[^A-Za-z0-9'\s]", " ")


def transcript(c: Column | str) -> Column:
    """The plain comparable form: lower case, punctuation out, white space collapsed; '' for null."""
    return squeeze(plain(F.lower(F.coalesce(_col(c), F.lit("")))))


def tokens(c: Column | str) -> Column:
    """Words of an already plain text; none for ''."""
    return F.filter(F.split(_col(c), " "), lambda w: w != "")


def without_hesitations(c: Column | str) -> Column:
    return F.array_join(F.filter(F.split(_col(c), " "), lambda w: ~w.isin(*HESITATIONS)), " ")


def for_scoring(c: Column | str) -> Column:
    """The canonical key of error rates: the transcript form without fillers."""
    return squeeze(without_hesitations(transcript(c)))


def strict(c: Column | str) -> Column:
    """Lower-case letters and digits only; apostrophes go too."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^a-z0-9\s]", " "))


def without_marks(c: Column | str) -> Column:
    """Bracketed noise marks such as [noise], (cough) and <unk> become spaces."""
    return F.regexp_replace(_col(c), r"\[[^\]]*\]|\([^)]*\)|<[^>]*>", " ")


@F.arrow_udf(StringType())
def compatible(texts: pa.Array) -> pa.Array:
    """Unicode compatibility composition, which Spark has no function for."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def for_evaluation(c: Column | str) -> Column:
    """Compatibility form, plain quotes, noise marks out, then the transcript form."""
    return transcript(without_marks(F.translate(compatible(F.coalesce(_col(c), F.lit(""))), *QUOTES)))


def label_case(vocabulary: set[str] | None) -> str:
    """lower if most of a vocabulary's single letters are, else upper."""
    single = [x for x in vocabulary or () if len(x) == 1 and x.isalpha()]
    return "lower" if sum(x.islower() for x in single) > sum(x.isupper() for x in single) else "upper"


def label(c: Column | str, vocabulary: set[str] | None = None) -> Column:
    """The form of training labels: ASCII letters and apostrophes, in the vocabulary's case, of its characters where it has any."""
    t = F.translate(compatible(F.coalesce(_col(c), F.lit(""))), *QUOTES)
    t = F.regexp_replace(t, r"\[[^\]]+\]|\([^)]+\)|<[^>]+>", " ")
    t = F.lower(t) if label_case(vocabulary) == "lower" else F.upper(t)
    single = {x for x in vocabulary or () if len(x) == 1}
    kept = [x for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'" if not single or x in single]
    return squeeze(F.regexp_replace(t, f"[^{''.join(kept)} ]", " "))


def word_count(c: Column | str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(WORD), F.lit(0)))


def syllables(c: Column | str) -> Column:
    """Estimated: each word has as many syllables as vowel runs, one at least."""
    runs = F.transform(tokens(strict(c)), lambda w: F.greatest(F.lit(1), F.size(F.regexp_extract_all(w, F.lit(VOWEL_RUN), F.lit(0)))))
    return F.aggregate(runs, F.lit(0), lambda a, x: a + x)


def family(c: Column | str) -> Column:
    """A word's last two letters."""
    return F.right(strict(c), F.lit(2))


def onset(c: Column | str) -> Column:
    return F.regexp_extract(strict(c), "^([^aeiou]*)(.*)$", 1)


def rime(c: Column | str) -> Column:
    return F.regexp_extract(strict(c), "^([^aeiou]*)(.*)$", 2)


def skeleton(c: Column | str) -> Column:
    """Consonants of a word."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[aeiouy]|[^a-z]", "")


def is_cvc(c: Column | str) -> Column:
    return strict(c).rlike("^[^aeiou][aeiou][^aeiou]$")


def prompt_kind(c: Column | str) -> Column:
    """letter, word, sentence or unknown, by the words of the transcript form."""
    t = transcript(c)
    n = F.size(tokens(t))
    return F.when(n == 0, "unknown").when((n == 1) & (F.length(t) == 1), "letter").when(n == 1, "word").otherwise("sentence")


def item_kind(c: Column | str) -> Column:
    """question, letter, word, phrase (up to four words without a stop) or sentence; blank for blank."""
    t = F.trim(F.coalesce(_col(c), F.lit("")))
    n = word_count(t)
    return (
        F.when(t == "", "blank")
        .when(t.endswith("?"), "question")
        .when(F.length(t) == 1, "letter")
        .when(n <= 1, "word")
        .when((n <= 4) & ~t.rlike("[.!?]"), "phrase")
        .otherwise("sentence")
    )


def accepted_answers(c: Column | str) -> Column:
    """A cell with answers as an array: a JSON array, or parts between bars, or between commas, or the cell itself."""
    t = F.trim(F.coalesce(_col(c), F.lit("")))
    parts = (
        F.when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.array(t)))
        .when(t.contains("|"), F.split(t, r"\|"))
        .when(t.contains(","), F.split(t, ","))
        .otherwise(F.array(t))
    )
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def truthy(c: Column | str, default: bool = False) -> Column:
    said = F.nullif(F.lower(F.trim(_col(c).cast("string"))), F.lit(""))
    return F.coalesce(said.isin("1", "true", "yes", "y", "active"), F.lit(default))


def not_denied(c: Column | str, default: bool = True) -> Column:
    """False for a word of denial only."""
    said = F.nullif(F.lower(F.trim(_col(c).cast("string"))), F.lit(""))
    return F.coalesce(~said.isin("0", "false", "no", "inactive"), F.lit(default))


def number(c: Column | str) -> Column:
    return _col(c).cast("string").try_cast("double")


def prefix_steps(c: Column | str, limit: int = 12) -> Column:
    """The distinct scoring forms that a text runs through as it grows letter by letter, up to ``limit``."""
    t = F.coalesce(_col(c), F.lit(""))
    forms = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: for_scoring(F.substr(t, F.lit(1), i)))
    add = lambda acc, x: F.when((x == "") | F.coalesce(F.element_at(acc, -1) == x, F.lit(False)), acc).otherwise(F.array_append(acc, x))
    grown = F.aggregate(forms, F.array(F.lit("")).cast("array<string>"), add)
    return F.slice(grown, 2, limit)


def age_group(c: Column | str) -> Column:
    """child, teen or adult; '' for what is no number."""
    age = _col(c).cast("string").try_cast("int")
    return F.when(age.isNull(), "").when(age < 13, "child").when(age < 18, "teen").otherwise("adult")


def speaker_type(c: Column | str) -> Column:
    g = age_group(c)
    return F.when(g == "teen", "child").otherwise(g)


def header(c: Column | str) -> Column:
    """A column's name as written in a header: trimmed, lower case, hyphens and blanks as underscores."""
    return F.translate(F.lower(F.trim(F.coalesce(_col(c), F.lit("")))), "- ", "__")
