"""Answer normalisation, parsing and prompt building as Column -> Column functions.

``strip`` and ``split`` here follow Unicode white space, as text processing outside SQL usually does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tables of the public visual question answering evaluator.
NUMBER_WORDS = {
    "none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}
ARTICLES = ("a", "an", "the")
PUNCTUATION = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've",
    "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't",
    "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's",
    "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've",
    "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am",
    "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't", "mustve": "must've",
    "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's",
    "shouldve": "should've", "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've",
    "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've", "somebodyll": "somebody'll", "somebodys": "somebody's",
    "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's",
    "somethingd": "something'd", "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll",
    "thats": "that's", "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's",
    "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas",
    "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't",
    "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's", "whereve": "where've",
    "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's",
    "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've",
    "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll", "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've",
    "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}
#: Words that never name an object in a question.
OBJECT_STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "am", "be", "been", "being", "do", "does", "did", "you", "your", "see", "there", "any", "many",
    "much", "what", "which", "who", "whom", "whose", "where", "when", "why", "how", "this", "that", "these", "those", "in", "on", "at", "of", "to",
    "for", "with", "from", "by", "as", "or", "and", "not", "no", "yes", "if", "than", "have", "has", "had", "can", "could", "would", "should", "will",
    "shall", "may", "might", "must", "it", "its", "he", "she", "they", "we", "i", "me", "my", "his", "her", "their", "our", "them", "him", "us",
    "image", "picture", "photo", "pic", "show", "shown", "look", "like", "color", "type", "kind", "number", "count", "total", "left", "right",
]
#: Neutral names given to detected persons, by object index.
PERSON_NAMES = ("Casey", "Riley", "Jessie", "Jackie", "Avery", "Jaime", "Peyton", "Kerry", "Jody", "Kendall", "Skyler", "Frankie", "Pat", "Quinn")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Split on white space without empty parts."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def first_line(c: Column) -> Column:
    return F.split(c, "\n", 2)[0]


_MARKS = "".join(PUNCTUATION)
_BESIDE_BLANK = "(?<= )[" + "".join("\\" + p for p in PUNCTUATION) + "]|[" + "".join("\\" + p for p in PUNCTUATION) + "](?= )"


def drop_stops(text: Column, most: int | None = None) -> Column:
    """Full stops that no digit follows go; with ``most`` only the first so many (the public evaluator's 32)."""
    if most is None:
        return F.regexp_replace(text, r"\.(?!\d)", "")
    parts = F.split(text, r"\.(?!\d)", -1)
    rest = F.slice(parts, most + 2, F.greatest(F.size(parts), F.lit(1)))
    return F.concat(F.array_join(F.slice(parts, 1, most + 1), ""), F.when(F.size(parts) > most + 1, F.concat(F.lit("."), F.array_join(rest, "."))).otherwise(F.lit("")))


def process_punctuation(text: Column, most_stops: int | None = None) -> Column:
    """Marks that stand beside a blank somewhere in the text go, all of them after a digit pair like 1,2; others become blanks."""
    touched = F.when(text.rlike(r"\d,\d"), F.lit(_MARKS)).otherwise(F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(_BESIDE_BLANK), F.lit(0))), ""))
    others = F.call_function("translate", F.lit(_MARKS), touched, F.lit(""))
    return drop_stops(F.call_function("translate", text, F.concat(others, touched), F.repeat(F.lit(" "), F.length(others))), most_stops)


def process_digit_article(text: Column) -> Column:
    """Listed words are found in a hash set; only those are looked up."""
    mapped = lambda w, table: F.when(w.isin(*table), lookup(table)[w]).otherwise(w)
    kept = F.filter(F.transform(words(F.lower(text)), lambda w: mapped(w, NUMBER_WORDS)), lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(kept, lambda w: mapped(w, CONTRACTIONS)), " ")


def plain_blanks(c: Column) -> Column:
    return strip(F.translate(c, "\n\t", "  "))


def normalise_answer(c: Column) -> Column:
    return process_digit_article(process_punctuation(plain_blanks(c)))


def vqa_soft_score(predicted: Column, truths: Column) -> Column:
    """Leave-one-out mean of min(matches / 3, 1); answers are normalised only if the truths differ.  No truths: null."""
    gts = F.transform(truths, plain_blanks)
    differ = F.size(F.array_distinct(gts)) > 1
    pred = F.when(differ, normalise_answer(predicted)).otherwise(plain_blanks(predicted))
    gts = F.when(differ, F.transform(gts, normalise_answer)).otherwise(gts)
    m, n = F.size(F.filter(gts, lambda g: g == pred)).cast("double"), F.size(gts).cast("double")
    one = F.lit(1.0)
    return F.when(n > 0, (m * F.least((m - 1) / 3, one) + (n - m) * F.least(m / 3, one)) / n)


def truncate_short_answer(c: Column) -> Column:
    line = strip(first_line(strip(c)))
    out = line
    for sep in ("; ", ". "):  # the first of ". ", "; " that fits wins
        head = strip(F.split(line, sep.replace(".", r"\."), 2)[0])
        out = F.when(F.contains(line, F.lit(sep)) & (F.length(head) <= 80), head).otherwise(out)
    return F.regexp_replace(out, r"\.+$", "")


def submission_answer(c: Column) -> Column:
    line = F.regexp_replace(strip(first_line(strip(c))), r"\.+$", "")
    return F.when(line == "", F.lit("unknown")).otherwise(line)


def drop_final_dots(c: Column) -> Column:
    """First line without all its final full stops; an empty output stays empty."""
    return F.regexp_replace(strip(first_line(strip(c))), r"\.+$", "")


def drop_final_dot(c: Column) -> Column:
    """First line without one final full stop."""
    return F.regexp_replace(strip(first_line(strip(c))), r"\.$", "")


def yes_no(c: Column) -> Column:
    return F.nullif(F.regexp_extract(normalise_answer(c), r"(?U)\b(yes|no)\b", 1), F.lit(""))


def option_letter(text: Column, options: Column) -> Column:
    """``options``: map letter -> value.  The first letter named in the text, else the only exactly equal option, else null."""
    named = F.regexp_extract(F.upper(text), r"(?U)(?:^|\b|\()([A-D])(?:\b|\)|[.:])", 1)
    same = F.filter(F.map_entries(options), lambda e: normalise_answer(e["value"]) == normalise_answer(text))
    return F.when(F.map_contains_key(options, named), named).when(F.size(same) == 1, same[0]["key"])


def usable_option(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(strip(c)).isin("", "nan", "none")


def option_map(a: Column, b: Column, c: Column, d: Column, keep_all: bool = False) -> Column:
    made = F.map_from_arrays(F.array(*(F.lit(x) for x in "ABCD")), F.array(a, b, c, d))
    return made if keep_all else F.map_filter(made, lambda k, v: usable_option(v))


def mcq_prompt(question: Column, options: Column, hint: Column | None = None) -> Column:
    lines = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"]))
    parts = [question, F.array_join(lines, "\n")]
    if hint is not None:
        parts.insert(0, F.when(F.lower(hint).isin("", "nan", "none"), F.lit(None)).otherwise(hint))
    return F.concat_ws("\n", *parts)


def choices_prompt(question: Column, choices: Column) -> Column:
    """Question, ``Options:`` and up to four ``A) ...`` lines."""
    lines = F.transform(F.slice(choices, 1, 4), lambda c, i: F.concat(F.element_at(F.array(*(F.lit(x) for x in "ABCD")), i + 1), F.lit(") "), c))
    return F.concat_ws("\n", question, F.lit("Options:"), F.array_join(lines, "\n"))


def index_key(c: Column) -> Column:
    """null and NaN -> '', whole numbers without fraction, anything else stripped."""
    text = strip(c.cast("string"))
    return F.when(c.isNull() | F.lower(text).isin("nan"), F.lit("")).otherwise(F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1"))


def slug(c: Column, default: str = "object") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", F.lit(default)).otherwise(made)


def span_text(caption: Column, start: Column, end: Column) -> Column:
    """caption[start:end] without outer blanks; 0-based, end exclusive."""
    return strip(F.substring(caption, start + 1, end - start))


def split_tags(c: Column) -> Column:
    """'a | b' -> [a, b]."""
    return F.filter(F.transform(F.split(c, r"\|"), strip), lambda t: t != "")


def bind(value: Column, f) -> Column:
    """``f`` of a value that is worked out once a row, however often ``f`` names it, also in inner lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_seen(tags: Column) -> Column:
    """Case-insensitive distinct tags; the first spelling and the first place win.  Sorted twice, so long lists take little time."""
    keyed = F.transform(tags, lambda t, i: F.struct(F.lower(strip(t)).alias("key"), i.alias("at"), strip(t).alias("tag")))
    ordered = F.array_sort(F.filter(keyed, lambda x: x["key"] != ""))

    def heads(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"]))

    placed = F.array_sort(F.transform(bind(ordered, heads), lambda x: F.struct(x["at"].alias("at"), x["tag"].alias("tag"))))
    return F.transform(placed, lambda x: x["tag"])


def merge_tags(*lists: Column) -> Column:
    return first_seen(F.concat(*lists))


def select_tags(raw: Column, tags: Column) -> Column:
    """Phrases of ``raw`` (cut at '.' or '|') mapped to known tags: equal first, else the first that holds or is held."""
    phrases = F.filter(F.transform(F.split(raw, r"\s*\.\s*|\|"), lambda p: F.lower(strip(p))), lambda p: p != "")
    # A repeated tag keeps its first place and its last spelling.
    at = F.array_distinct(F.transform(tags, F.lower))
    spelled = F.transform(at, lambda k: F.element_at(F.filter(tags, lambda t: F.lower(t) == k), -1))
    pairs = F.arrays_zip(at.alias("key"), spelled.alias("tag"))

    def pick(p: Column) -> Column:
        equal = F.filter(pairs, lambda x: x["key"] == p)
        part = F.filter(pairs, lambda x: F.contains(p, x["key"]) | F.contains(x["key"], p))
        return F.when(F.size(equal) > 0, equal[0]["tag"]).when(F.size(part) > 0, part[0]["tag"])

    return first_seen(F.filter(F.transform(phrases, pick), lambda t: t.isNotNull()))


def question_nouns(question: Column) -> Column:
    """Words that may name objects: no stop words, rough singular, first seen."""
    found = F.filter(F.transform(F.regexp_extract_all(question, F.lit("[A-Za-z]+"), 0), F.lower), lambda w: ~w.isin(*OBJECT_STOPWORDS) & (F.length(w) > 1))
    ies = lambda w: (F.length(w) > 4) & w.endswith("ies")
    plural = lambda w: (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
    return first_seen(F.transform(found, lambda w: F.when(ies(w), F.concat(F.left(w, F.length(w) - 3), F.lit("y"))).when(plural(w), F.left(w, F.length(w) - 1)).otherwise(w)))


def grounding_prompt(question: Column, tags: Column, mode: str = "hybrid") -> Column:
    """Tags joined by ' . '; mode 'question' uses question nouns only; nothing left -> 'object'."""
    lists = (question_nouns(question),) if mode == "question" else (question_nouns(question), tags)
    merged = F.array_join(merge_tags(*lists), " . ")
    return F.when(merged == "", F.lit("object")).otherwise(merged)


def prompt_tags(prompt: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(prompt, F.lit("")), r" \. "), strip), lambda t: t != "")


def parse_boxes(text: Column) -> Column:
    """'x1,y1,x2,y2; ...' -> array of structs; a box without four numbers raises."""
    parts = F.filter(F.transform(F.split(strip(text), ";"), strip), lambda p: p != "")

    def box(p: Column) -> Column:
        v = F.transform(F.split(p, ","), lambda x: strip(x).cast("double"))
        bad = F.raise_error(F.concat(F.lit("a box needs 4 values: "), p)).cast("double")
        return F.struct(*(F.when(F.size(v) != 4, bad).otherwise(F.try_element_at(v, F.lit(i + 1))).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))

    return F.transform(parts, box)


def object_names(objects: Column) -> Column:
    """Persons get neutral names by object index, others their class, nameless ones 'object<k>'."""
    names = F.array(*(F.lit(n) for n in PERSON_NAMES))

    def name(o: Column, i: Column) -> Column:
        kind = F.lower(strip(o))
        return F.when(kind == "person", F.element_at(names, (i % len(PERSON_NAMES) + 1).cast("int"))).when(kind == "", F.concat(F.lit("object"), (i + 1).cast("string"))).otherwise(kind)

    return F.transform(objects, name)


def resolve_detections(text: Column, objects: Column) -> Column:
    """Whole numbers 1..n in the text become the names of the detected objects; others stay.

    The text is cut at number borders, so each number is a part of its own: no Python is needed.
    """
    parts = F.split(text, r"(?U)(?<=\d)(?=\D)|(?<=\D)(?=\d)|\b")

    def resolved(v: Column) -> Column:
        names, parts = v["names"], v["parts"]

        # Only numbers standing alone count: neighbours must not be word characters.
        def alone(p: Column, i: Column) -> Column:
            left, right = F.coalesce(F.get(parts, i - 1), F.lit("")), F.coalesce(F.get(parts, i + 1), F.lit(""))
            k = p.try_cast("int")
            number = p.rlike(r"^\d+$") & (k >= 1) & (k <= F.size(names)) & ~left.rlike(r"(?U)\w$") & ~right.rlike(r"(?U)^\w")
            return F.when(number, F.try_element_at(names, k)).otherwise(p)

        return F.array_join(F.transform(parts, alone), "")

    whole = bind(F.struct(object_names(objects).alias("names"), parts.alias("parts")), resolved)
    return F.when((F.size(objects) > 0) & (text != ""), whole).otherwise(text)


def tokens_text(tokens: Column, objects: Column) -> Column:
    """Tokens (variant: strings, or lists of 0-based object numbers) joined by blanks; unknown numbers as number + 1."""
    names = object_names(objects)
    label = lambda k: F.when((k >= 0) & (k < F.size(names)), F.try_element_at(names, k + 1)).otherwise((k + 1).cast("string"))
    lists = F.transform(tokens, lambda t: F.try_variant_get(t, "$", "array<int>"))
    each = F.transform(F.arrays_zip(tokens.alias("t"), lists.alias("l")), lambda x: F.when(x["l"].isNotNull(), F.transform(x["l"], label)).otherwise(F.array(F.try_variant_get(x["t"], "$", "string"))))
    return F.array_join(F.flatten(each), " ")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def choices_answer(choices: Column, correct: Column) -> Column:
    """The letter of choice 0..3, the choice itself beyond."""
    letters = F.array(*(F.lit(x) for x in "ABCD"))
    return F.when((correct >= 0) & (correct < 4), F.try_element_at(letters, (correct + 1).cast("int"))).otherwise(F.try_element_at(choices, (correct + 1).cast("int")))
