"""Column functions on text: normal forms, tokens, extracted codes, keys, checks."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters that are drawn like Cyrillic ones, in pairs of equal place.
LATIN_LIKE, CYRILLIC_LIKE = "abcehkmoptxyABCEHKMOPTXY", "авсенкмортхуАВСЕНКМОРТХУ"


def squeeze(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_text(text: Column) -> Column:
    """Lower case, ё as е, white space squeezed."""
    return squeeze(F.translate(F.lower(text), "ё", "е"))


def question_key(text: Column) -> Column:
    """The normal form with letters, digits and blanks only."""
    return squeeze(F.regexp_replace(norm_text(text), r"[^\p{L}\p{N} ]+", ""))


#: Runs of Russian and plain Latin letters and digits, in lower case.
TOKEN = "[а-яёa-z0-9]+"


def raw_tokens(text: Column) -> Column:
    """Runs of Russian and plain Latin letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def one_alphabet(token: Column) -> Column:
    """A Latin e before digits is the Cyrillic one, as in codes of additives; ё is е."""
    return F.translate(F.regexp_replace(token, "^e([0-9]+)$", "е$1"), "ё", "е")


#: The vowels and endings of the Snowball stemmer of Russian. Of two groups the first follows а or я,
#: which stays.
VOWELS = "аеиоуыэюя"
GERUND = ("в|вши|вшись", "ив|ивши|ившись|ыв|ывши|ывшись")
REFLEXIVE = "ся|сь"
ADJECTIVE = "ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею"
PARTICIPLE = ("ем|нн|вш|ющ|щ", "ивш|ывш|ующ")
VERB = (
    "ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно",
    "ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю",
)
NOUN = "а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я"


def _ending(*groups: str) -> str:
    """A pattern of endings: one group, or two of which the first needs an а or я before it."""
    return f"(?:{groups[0]})$" if len(groups) == 1 else f"(?:([ая])(?:{groups[0]})|(?:{groups[1]}))$"


_HEAD = re.compile(f"[^{VOWELS}]*[{VOWELS}]")
_FAR = re.compile(f".*?[{VOWELS}][^{VOWELS}].*?[{VOWELS}][^{VOWELS}]")
_GERUND, _REFLEXIVE, _ADJECTIVE, _PARTICIPLE, _VERB, _NOUN = (re.compile(_ending(*([g] if isinstance(g, str) else g))) for g in (GERUND, REFLEXIVE, ADJECTIVE, PARTICIPLE, VERB, NOUN))


_CODE = re.compile("^e([0-9]+)$")


def stem(word: str) -> str:
    """The word without its Russian ending, by the rules of Snowball; words with digits or Latin letters stay."""
    head = _HEAD.match(word)
    if head is None or not word.isalpha() or re.search("[a-z]", word):
        return word
    start, rest = head[0], word[head.end() :]
    keep = lambda m: (m[1] or "") if m.re.groups else ""
    first = _GERUND.sub(keep, rest)
    if first == rest:
        plain = _REFLEXIVE.sub("", rest)
        first = _ADJECTIVE.sub("", plain)
        if first != plain:
            first = _PARTICIPLE.sub(keep, first)
        else:
            first = _VERB.sub(keep, plain)
            if first == plain:
                first = _NOUN.sub("", plain)
    first = first.removesuffix("и")
    far = _FAR.match(word)
    if far and (ost := re.search("ость?$", first)) and len(start) + ost.start() >= far.end():
        first = first[: ost.start()]
    best = re.sub("ейше?$", "", first)
    if best != first or first.endswith("нн"):
        return start + re.sub("нн$", "н", best)
    return start + first.removesuffix("ь")


@functools.lru_cache(maxsize=1 << 18)
def search_form(token: str) -> str:
    """A token of ``TOKEN`` as :func:`stemmed` gives it."""
    return stem((_CODE.sub(r"е\1", token)).replace("ё", "е"))


def stemmed(tokens: DataFrame, raw: str, name: str) -> DataFrame:
    """(raw, name): each token in one alphabet and without its Russian ending. Meant for the distinct tokens of a corpus."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[raw], pa.array([stem(t) for t in batch["_token"].to_pylist()], pa.string())], [raw, name])

    return tokens.where(F.col(raw).isNotNull()).select(raw, one_alphabet(F.col(raw)).alias("_token")).mapInArrow(run, f"`{raw}` string, `{name}` string")


def tokens(text: Column) -> Column:
    """Tokens of a text in one alphabet, as written; :func:`stemmed` gives their search form."""
    return F.transform(raw_tokens(text), one_alphabet)


def words(text: Column, least: int = 3) -> Column:
    """Distinct words of at least ``least`` letters or digits, ё as е, in order of appearance."""
    found = F.regexp_extract_all(F.translate(F.lower(text), "ё", "е"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= least))


def word_list(text: Column, least: int = 3) -> Column:
    """As :func:`words`, repeated words kept."""
    found = F.regexp_extract_all(F.translate(F.lower(text), "ё", "е"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w) >= least)


def additive_codes(text: Column) -> Column:
    """Codes such as E322 in either alphabet, distinct, in order: a Cyrillic е and the digits."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?:^|[^\p{L}\p{N}])[eе] ?([0-9]{3,4}[a-dа-г]?)(?![0-9])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda c: F.concat(F.lit("е"), F.translate(c, "abcd", "абвг"))))


def digit_runs(text: Column, least: int = 8) -> Column:
    """Runs of digits with blanks inside taken out, of at least ``least`` digits."""
    found = F.regexp_extract_all(text, F.lit(r"\d[\d ]*\d|\d"), F.lit(0))
    return F.filter(F.transform(found, lambda r: F.replace(r, F.lit(" "), F.lit(""))), lambda r: F.length(r) >= least)


def fold_look_alikes(text: Column) -> Column:
    """Latin look-alike letters as Cyrillic ones."""
    return F.translate(text, LATIN_LIKE, CYRILLIC_LIKE)


def is_mixed_script(text: Column) -> Column:
    return text.rlike(r"\p{IsCyrillic}") & text.rlike(r"\p{IsLatin}")


def number(text: Column) -> Column:
    """A number with a decimal comma or point, else null."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def parse_time(text: Column) -> Column:
    """A time in one of the two formats in use, from the first 19 characters, else null."""
    short = F.substring(text, 1, 19)
    return F.coalesce(F.try_to_timestamp(short, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(short, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def short_hash(*parts: Column, length: int = 16) -> Column:
    """The first characters of the SHA-256 of the parts, joined by a unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length)


def ean13_digit(prefix: Column) -> Column:
    """The check digit of twelve digits."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(12)),
        F.lit(0),
        lambda acc, i: acc + F.substring(prefix, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3),
    )
    return (10 - total % 10) % 10


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def tail_sentence(text: Column, least: int = 40, limit: int = 220) -> Column:
    """The last sentence; if shorter than ``least``, with the one before it; cut at ``limit``."""
    parts = F.filter(F.split(squeeze(text), r"(?<=[.!?]) "), lambda s: F.length(s) > 0)
    last = F.try_element_at(parts, F.lit(-1))
    before = F.try_element_at(parts, F.lit(-2))
    return F.substring(F.when((F.length(last) < least) & before.isNotNull(), F.concat_ws(" ", before, last)).otherwise(last), 1, limit)


def header(*fields: Column) -> Column:
    """The non-empty fields joined by full stops."""
    return F.concat_ws(". ", *(F.nullif(f, F.lit("")) for f in fields))


def header_and_text(head: Column, text: Column) -> Column:
    return F.when(head != "", F.concat(head, F.lit("\n"), text)).otherwise(text)
