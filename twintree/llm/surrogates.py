"""Operator 5: personal data replaced by keyed surrogates, in DataFrame functions only.

Detected: e-mail addresses (domains of up to 127 labels, as DNS has it), phone numbers, IPv4 addresses, card numbers,
social security numbers, IBANs, access keys and quoted secrets, and names after a title, with initials, particles and
apostrophes, also in capitals. An entity's canonical form (digits of a number, lower-cased address, gender and name) and a
secret key give its surrogate through SHA-256, so one entity has one surrogate wherever and however it is written. The
surrogate keeps the type, the layout, letter case and script; titles stay, and names end as their gender's do; a card
number or IBAN whose check digits are right gets a surrogate whose check digits are; addresses of one domain share theirs,
which has 64 bits of the domain's digest.

The words of a titled name also stand for the person without the title: wherever else in the document one of them (of
three letters or more) stands as a word of its own, it becomes the surrogate's word in that place. If two names of a
document share a word, the first one has it. Names that no title announces anywhere in a document are not found.

Collisions: all distinct entities are given surrogates first. Where two have the same one, or a surrogate is itself an
entity of the corpus, all but the smallest are given the next attempt, until all are distinct. From attempt 21 on a
surrogate is longer than its entity, by two letters or digits more with each attempt (private addresses become public
ones instead), so that few possible values do not keep entities together; if 60 attempts do not part all, the operator
fails. A secret or mailbox of signs only is longer from the first. The few entities with a later attempt are the only
ones looked up; every other text is rewritten by a function of itself, without a join.

Cases: a null text stays null with no entities; an empty text stays empty; repeated rows are rewritten alike; other
columns are handed through, n_chars (if there is one) is counted anew; a column named n_entities is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Titles by gender, syllables by script, name endings by script and gender.
MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|Госпожа"
# In capitals a title needs its full stop, since shouted texts hold such words.
MALE_CAPITALS, FEMALE_CAPITALS = "MR|HERR|SR|ГОСПОДИН", "MRS|MS|FRAU|MME|SRA|ГОСПОЖА"
SYLLABLES = {
    "latin": "ba be bo da de do fa fi ga ge ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se si ta te to va ve vi za zo".split(),
    "cyrillic": "ба бе бо да де до ка ке ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се си та те то ва ве ви за зо".split(),
    "greek": "βα βε γα δα δε ζα θα κα κε λα λε λι μα με μι να νε πα πε ρα ρε σα σε τα τε φα φι".split(),
}
ENDINGS = {"latin": ("rnan", "lina"), "cyrillic": ("слав", "нина"), "greek": ("νος", "νια")}

LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"(?:\p{Lu}['’])?(?:\p{Lu}\p{Ll}{1,3})?\p{Lu}\p{Ll}+"
# Particles of family names.
PARTICLES = "van|von|de|del|della|di|da|der|den|ter|la|le|zu|dos"
_NAME = rf"(?:\p{{Lu}}\. ?){{0,3}}(?:(?:{PARTICLES}) ){{0,2}}{_WORD}(?:[ -](?:(?:{PARTICLES}) ){{0,2}}{_WORD})?"
_CAPITALS = r"(?:\p{Lu}\. ?){0,3}(?:\p{Lu}['’])?\p{Lu}{2,}+(?:-\p{Lu}{2,}+)?"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,24}",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "name": rf"\b(?:{FEMALE}|{MALE})\.? {_NAME}|\b(?:(?:{FEMALE_CAPITALS}|{MALE_CAPITALS})\. ){_CAPITALS}",
    "secret": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}+|\bsk-[A-Za-z0-9_-]{20,}+|(?<=(?i:token|secret|password|passwd|api.key)\s{0,3}[=:]\s{0,3}[\"'])[^\"'\s]{8,}+(?=[\"'])",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Line ends outside of what leads to a quoted secret: nothing else in the patterns goes across a line's end.
_LINE_END = r"\n(?!\s{0,2}[=:]\s{0,3}[\"'](?<=(?i:token|secret|password|passwd|api.key)\s{0,3}[=:]\s{0,3}[\"'])|\s{0,2}[\"'](?<=(?i:token|secret|password|passwd|api.key)\s{0,3}[=:]\s{0,3}[\"']))"
# Attempts that keep the layout, and attempts in all.
LAYOUT_ATTEMPTS = 20
ATTEMPTS = 60
# What access keys begin with: they need no digit or sign.
KEY_STARTS = ("AKIA", "ASIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")


def kind_of(entity: Column) -> Column:
    found = F.lit("secret")
    for kind in reversed([k for k in PATTERNS if k != "secret"]):
        found = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(found)
    return found


def _bare_name(entity: Column) -> Column:
    return F.regexp_replace(entity, rf"^(?:{FEMALE}|{MALE}|{FEMALE_CAPITALS}|{MALE_CAPITALS})\.? ", "")


def _gender(entity: Column) -> Column:
    return F.when(entity.rlike(rf"^(?:{FEMALE}|{FEMALE_CAPITALS})\.? "), "f").otherwise("m")


def canonical(kind: Column, entity: Column) -> Column:
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, r"\D", ""))
        .when(kind == "email", F.lower(entity))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "name", F.concat(_gender(entity), F.lit("|"), F.lower(_bare_name(entity))))
        .otherwise(entity)
    )


def _number(seed: Column, place: Column | str, below: int) -> Column:
    """A number from 0 to below - 1 that depends on the seed and the place."""
    text = F.concat(seed, F.lit("|"), place.cast("string") if isinstance(place, Column) else F.lit(place))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long"), F.lit(below))


def _letter(alphabet: str, at: Column) -> Column:
    return F.substr(F.lit(alphabet), at.cast("int") + 1, F.lit(1))


def _wider(seed: Column, width: Column, pieces: str | list[str]) -> Column:
    """`width` further pieces."""
    parts = F.array(*map(F.lit, pieces))
    drawn = F.transform(F.sequence(F.lit(1), width), lambda i: F.element_at(parts,
        (_number(seed, F.concat(F.lit("more"), i.cast("string")), len(pieces)) + 1).cast("int")))
    return F.when(width > 0, F.array_join(drawn, "")).otherwise("")


def _least_width(text: Column, width: Column) -> Column:
    """Signs are not exchanged, so a text of signs only is made longer."""
    return F.when(text.rlike(r"[\p{L}\p{N}]"), width).otherwise(width + 2)


def _same_shape(text: Column, seed: Column, keep: int, latin: str = LETTERS) -> Column:
    """Letters and digits after the first `keep` are exchanged for others of their kind, case and script.

    Linear in the text: letters and digits are drawn by their number, then put back between the signs.
    """

    def one(c: Column, i: Column) -> Column:
        place = i + 1
        drawn = _letter(latin, _number(seed, place, len(latin)))
        low = F.when(c.rlike(r"\p{IsCyrillic}"), _letter("абвгдежзиклмнопрст", _number(seed, place, 18))).when(c.rlike(r"\p{IsGreek}"),
            _letter("αβγδεζηθικλμνοπρτυ", _number(seed, place, 18))).otherwise(drawn)
        return F.when((c == "") | (place <= keep), c).when(c.rlike(r"\p{N}"), _number(seed, place, 10).cast("string")).when(c.rlike(r"\p{Lu}"),
            F.upper(low)).otherwise(low)

    made = F.transform(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""), "", -1), one)
    signs = F.split(text, r"[\p{L}\p{N}]", -1)
    return F.array_join(F.zip_with(signs, made, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")


def _luhn_rest(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    n = F.length(digits)
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10


def _card(entity: Column, seed: Column, width: Column) -> Column:
    drawn = F.concat(_same_shape(entity, seed, keep=1), _wider(seed, width, DIGITS))
    digits = F.regexp_replace(drawn, r"\D", "")
    last = F.pmod(F.substr(digits, F.length(digits), F.lit(1)).cast("int") - _luhn_rest(digits), F.lit(10))
    valid = _luhn_rest(F.regexp_replace(entity, r"\D", "")) == 0
    return F.when(valid, F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), last.cast("string"))).otherwise(drawn)


def _iban_rest(account: Column) -> Column:
    """The number modulo 97 that an IBAN without spaces stands for: country and check digits last, letters as 10 to 35."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(
        F.ascii(F.upper(c)) - 55))
    return F.aggregate(values, F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _iban(entity: Column, seed: Column, width: Column) -> Column:
    drawn = F.concat(_same_shape(entity, seed, keep=2), _wider(seed, width, DIGITS))
    head, rest = F.substr(drawn, F.lit(1), F.lit(2)), F.substr(drawn, F.lit(5))
    check = F.lpad((98 - _iban_rest(F.concat(head, F.lit("00"), F.regexp_replace(rest, " ", "")))).cast("string"), 2, "0")
    return F.when(_iban_rest(F.regexp_replace(entity, " ", "")) == 1, F.concat(head, check, rest)).otherwise(drawn)


def _email(entity: Column, seed: Column, width: Column, key: str) -> Column:
    local, domain = F.substring_index(entity, "@", 1), F.lower(F.substring_index(entity, "@", -1))
    at = F.concat(F.lit(f"{key}|domain|"), domain)
    place = F.concat(F.lit("mail"), F.substring(F.sha2(at, 256), 1, 16), F.lit(".example."),
        F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), (_number(at, "zone", 3) + 1).cast("int")))
    return F.concat(_same_shape(local, seed, keep=0), _wider(seed, _least_width(local, width), LETTERS), F.lit("@"), place)


def _ip(entity: Column, seed: Column, width: Column) -> Column:
    rest = F.transform(F.sequence(F.lit(2), F.lit(4)), lambda i: (_number(seed, i, 254) + 1).cast("string"))
    first = F.when((width == 0) & entity.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)"), "10").otherwise(
        (_number(seed, "first", 112) + 11).cast("string"))
    return F.concat_ws(".", first, rest)


# Words of a name that are exchanged: all but initials and particles.
_NAME_WORD = rf"(?:\p{{Lu}}['’])?\p{{Lu}}[\p{{L}}]+"


def _name(entity: Column, seed: Column, width: Column) -> Column:
    """Title, initials, particles and what stands between stay; every other word is drawn, the last one ends by gender."""
    bare = _bare_name(entity)
    title = F.substr(entity, F.lit(1), F.length(entity) - F.length(bare))
    female = _gender(entity) == "f"
    words, between = F.regexp_extract_all(bare, F.lit(_NAME_WORD), F.lit(0)), F.split(bare, _NAME_WORD, -1)

    def build(script: str, word: Column, place: Column) -> Column:
        parts = F.array(*map(F.lit, SYLLABLES[script]))
        drawn = [F.element_at(parts, (_number(seed, F.concat(place.cast("string"), F.lit(f"word{k}")), len(SYLLABLES[script])) + 1).cast("int"))
            for k in range(4)]
        last = place == F.size(words) - 1
        made = F.initcap(F.concat(*drawn, F.when(last, _wider(seed, width, SYLLABLES[script])).otherwise(""),
            F.when(last & female, ENDINGS[script][1]).when(last, ENDINGS[script][0]).otherwise("")))
        return F.when(word == F.upper(word), F.upper(made)).otherwise(made)

    def one(word: Column, place: Column) -> Column:
        return F.when(word.rlike(r"\p{IsCyrillic}"), build("cyrillic", word, place)).when(word.rlike(r"\p{IsGreek}"),
            build("greek", word, place)).otherwise(build("latin", word, place))

    made = F.transform(words, one)
    return F.concat(title, F.array_join(F.zip_with(between, made, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), ""))


def _name_pairs(kind: Column, entity: Column, made: Column) -> Column:
    """(word, surrogate's word) of a name's exchanged words of three letters or more, as written and in capitals."""
    words = lambda x: F.regexp_extract_all(_bare_name(x), F.lit(_NAME_WORD), F.lit(0))
    pairs = F.zip_with(words(entity), words(made), lambda x, y: F.struct(x.alias("old"), y.alias("new")))
    title = lambda x: F.initcap(F.lower(x))
    wide = F.flatten(F.transform(pairs, lambda p: F.array(p, F.struct(F.upper(p["old"]).alias("old"), F.upper(p["new"]).alias("new")),
        F.struct(title(p["old"]).alias("old"), title(p["new"]).alias("new")))))
    kept = F.filter(wide, lambda p: p["old"].isNotNull() & p["new"].isNotNull() & (F.length(p["old"]) > 2))
    return F.when(kind == "name", kept).otherwise(F.array().cast("array<struct<old:string,new:string>>"))


def seed_of(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Long entities stand in it by their digest, since every letter drawn hashes the seed."""
    short = F.when(F.length(canon) > 128, F.sha2(canon, 256)).otherwise(canon)
    return F.concat(F.lit(f"{key}|"), kind, F.lit("|"), short, F.lit("|"), attempt.cast("string"))


def width_of(attempt: Column) -> Column:
    """By how many letters or digits the attempt's surrogates are longer."""
    return F.greatest(attempt - LAYOUT_ATTEMPTS, F.lit(0)) * 2


def surrogate(kind: Column, entity: Column, seed: Column, width: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(entity, seed, width, key))
        .when(kind == "ip", _ip(entity, seed, width))
        .when(kind == "card", _card(entity, seed, width))
        .when(kind == "phone", F.concat(_same_shape(entity, seed, keep=1), _wider(seed, width, DIGITS)))
        .when(kind == "ssn", F.concat(_same_shape(entity, seed, keep=0), _wider(seed, width, DIGITS)))
        .when(kind == "iban", _iban(entity, seed, width))
        .when(kind == "name", _name(entity, seed, width))
        .when(entity.rlike("^[0-9a-f]+$"), F.concat(_same_shape(entity, seed, keep=0, latin="abcdef"), _wider(seed, width, "abcdef")))
        .otherwise(F.concat(_same_shape(entity, seed, keep=0), _wider(seed, _least_width(entity, width), LETTERS)))
    )


def _may_hold(line: Column) -> Column:
    """False only for lines in which no pattern can match: a test of single characters and plain substrings."""
    found = line.rlike(r"[0-9@=]|:\s{0,3}[\"']")
    for title in f"{MALE}|{FEMALE}".split("|"):
        found = found | F.contains(line, F.lit(f"{title}. ")) | F.contains(line, F.lit(f"{title} "))
    for title in f"{MALE_CAPITALS}|{FEMALE_CAPITALS}".split("|"):
        found = found | F.contains(line, F.lit(f"{title}. "))
    for start in KEY_STARTS:
        found = found | F.contains(line, F.lit(start))
    return found


def _of_line(line: Column) -> Column:
    """The line's entities in order, as structs (entity, kind, canon); steps are nested so that each is evaluated once."""
    entities = F.regexp_extract_all(line, F.lit(ENTITY), F.lit(0))
    typed = F.transform(entities, lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
    return F.transform(typed, lambda s: F.struct(s["entity"].alias("entity"), s["kind"].alias("kind"), canonical(s["kind"], s["entity"]).alias("canon")))


def _lines(text: Column) -> Column:
    """Lines, or a few where a secret's keyword, sign and quote stand on several: no entity goes across an end of these."""
    return F.split(text, _LINE_END, -1)


def found_in(text: Column) -> Column:
    return F.flatten(F.transform(F.filter(_lines(text), _may_hold), _of_line))


def _later_attempts(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame | None:
    """(kind, canon, attempt) of the entities whose first surrogates collide; None if none does.

    entities: distinct (kind, canon, entity); entity is one way to write it.
    """
    kind, attempt = F.col("kind"), F.col("attempt")
    new = surrogate(kind, F.col("entity"), F.col("seed"), F.col("width"), key)

    def drawn(rows: DataFrame) -> DataFrame:
        seeded = rows.withColumn("seed", seed_of(kind, F.col("canon"), attempt, key)).withColumn("width", width_of(attempt))
        return seeded.withColumn("drawn", new).select("kind", "canon", "entity", "attempt", canonical(kind, F.col("drawn")).alias("made"))

    # few bytes but much work: without a number the rows would be put together in a task or two
    entities = entities.repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), "kind", "canon")
    state = scratch.save(drawn(entities.select("kind", "canon", "entity", F.lit(0).alias("attempt"))), "attempts")
    for last in range(ATTEMPTS + 1):
        first = state.groupBy("kind", "made").agg(F.min("canon").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        real = state.select("kind", F.col("canon").alias("made"))
        # only entities whose surrogate is shared or real move on; both tables hardly ever have rows
        shared = state.join(first, ["kind", "made"]).where("canon <> first").select("kind", "canon")
        taken = state.join(real, ["kind", "made"]).select("kind", "canon")
        moved = scratch.save(shared.unionByName(taken).distinct(), "moved")
        if not moved.limit(1).count():
            break
        if last == ATTEMPTS:
            left = {r["kind"]: r["count"] for r in moved.groupBy("kind").count().collect()}
            raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts, entities by kind: {left}")
        again = drawn(state.join(moved, ["kind", "canon"]).select("kind", "canon", "entity", (attempt + 1).alias("attempt")))
        state = scratch.save(state.join(moved, ["kind", "canon"], "left_anti").select(*again.columns).unionByName(again), "attempts")
    late = scratch.save(state.where("attempt > 0").select("kind", "canon", "attempt"), "late")
    return late if late.limit(1).count() else None


def replace_entities(docs: DataFrame, key: str = "twintree", text_col: str = "text") -> DataFrame:
    """docs with rewritten texts and n_entities."""
    docs = docs.drop("n_entities")
    scratch = Scratch(docs.sparkSession, "surrogates")
    text = F.col(text_col)
    seen = docs.select(F.explode(found_in(text)).alias("e")).groupBy("e.kind", "e.canon").agg(F.min("e.entity").alias("entity"))
    late = _later_attempts(seen, key, scratch)
    found = docs
    attempt = lambda s: F.lit(0)
    if late is not None:
        said = docs.select(F.sha2(text.cast("binary"), 256).alias("__digest"), F.explode(found_in(text)).alias("e")).select("__digest", "e.kind",
            "e.canon").join(late, ["kind", "canon"])
        known = scratch.save(said.groupBy("__digest").agg(F.map_from_entries(
            F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("__late")), "known")
        known = F.broadcast(known) if known.count() <= 10_000 else known
        found = found.withColumn("__digest", F.sha2(text.cast("binary"), 256)).join(known, "__digest", "left")
        attempt = lambda s: F.coalesce(F.try_element_at(F.col("__late"), F.concat_ws("|", s["kind"], s["canon"])), F.lit(0))

    def rewritten(s: Column) -> Column:
        seeded = F.transform(s["e"], lambda x: F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"),
            seed_of(x["kind"], x["canon"], attempt(x), key).alias("seed"), width_of(attempt(x)).alias("width")))
        drawn = F.transform(seeded, lambda x: F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"),
            surrogate(x["kind"], x["entity"], x["seed"], x["width"], key).alias("made")))
        none = F.coalesce(F.size(s["e"]), F.lit(0)) <= 0
        return F.struct(s["line"].alias("line"), F.when(~none, drawn).alias("drawn"))

    def joined(s: Column) -> Column:
        pieces = F.zip_with(F.split(s["line"], ENTITY, -1), s["drawn"], lambda x, y: F.concat(x, F.coalesce(y["made"], F.lit(""))))
        return F.when(s["drawn"].isNull(), s["line"]).otherwise(F.array_join(pieces, ""))

    split = F.transform(_lines(text), lambda line: F.struct(line.alias("line"), F.when(_may_hold(line), _of_line(line)).alias("e")))
    found = found.withColumn("__lines", F.transform(split, rewritten))
    count = F.coalesce(F.aggregate("__lines", F.lit(0), lambda n, s: n + F.coalesce(F.size(s["drawn"]), F.lit(0))), F.lit(0))
    pairs = F.flatten(F.flatten(F.transform(F.filter("__lines", lambda s: s["drawn"].isNotNull()),
        lambda s: F.transform(s["drawn"], lambda x: _name_pairs(x["kind"], x["entity"], x["made"])))))
    found = found.withColumns({"__text": F.array_join(F.transform("__lines", joined), "\n"), "__count": count, "__pairs": pairs}).drop("__lines")
    # bare words of titled names: the first name that has a word gives its surrogate; most documents have none
    olds = F.array_distinct(F.transform("__pairs", lambda p: p["old"]))
    found = found.withColumn("__olds", olds).withColumn("__names", F.map_from_arrays("__olds",
        F.transform("__olds", lambda w: F.element_at(F.filter("__pairs", lambda p: p["old"] == w), 1)["new"])))
    word = F.concat(F.lit(r"(?<![\p{L}\p{N}_'’@.-])(?:"), F.array_join("__olds", "|"), F.lit(r")(?![\p{L}\p{N}_@-])"))
    named = F.size("__olds") > 0
    found = found.withColumn("__word", F.when(named, word)).withColumn("__bare", F.when(named, F.regexp_extract_all("__text", F.col("__word"), F.lit(0))))
    again = F.zip_with(F.split(F.col("__text"), F.col("__word"), -1), F.transform("__bare", lambda w: F.col("__names")[w]), lambda x,
        y: F.concat(x, F.coalesce(y, F.lit(""))))
    more = F.coalesce(F.size("__bare"), F.lit(0)) > 0
    count = (F.coalesce("__count", F.lit(0)) + F.when(more, F.size("__bare")).otherwise(0)).cast("long")
    out = found.withColumn(text_col, F.when(more, F.array_join(again, "")).otherwise(F.col("__text"))).withColumn("__count", count)
    count = F.col("__count")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(count > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("n_entities", count).select(*docs.columns, "n_entities")
