"""Surrogates for personal data: keyed, type-consistent replacements that stay distinct.

Entities are detected by patterns: e-mail and IPv4 addresses, telephone, social-security, account and
card numbers (card numbers with a right check digit only), secrets (long hexadecimal strings and
key forms), and names behind a title. What a mention stands for is its entity: an address in lower case,
the digits of a number (the last ten of a telephone number), the letters and digits of an account, the
family name and the first name of a person. The surrogate of an entity follows from a key, its
type and itself, so all mentions of an entity get the same one (coreference), each in its own format:
digits stay digits, letters stay letters of their case and script, separators, country
codes and top-level domains stay, octets stay octets, card numbers pass their check, and names
keep their title, particles and number of words, with a first name of the title's gender in the name's script (that of
another mention in the document behind a title without gender). A name that is found behind a title is also
replaced where it stands without one in the same document (first and family name, or the family name alone, in the same case).

Distinctness is checked on the table of all distinct entities of the corpus: a surrogate that
another entity has, or that is itself an entity of the corpus, is drawn again. With the draws names grow by
syllables; after RELAXED draws addresses grow, octets may have other lengths and numbers give up a kept exchange
code; after LAST draws the surrogate is the type and 24 hexadecimal digits, of which there are always enough. Only
built-in functions are used, and texts go through the patterns once.

The key is spark.tracequill.surrogate.key; where it is unset, a random one that holds as long as the application.

Cases: a null text stays null with 0 entities; a text without an entity stays as it is; equal texts
get the same text; overlapping candidates go to the leftmost, then to the pattern
first in PATTERNS; n_entities counts places that the patterns find; an empty table gives no rows; the other columns are kept.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

CONF = "spark.tracequill.surrogate.key"
RELAXED = 6
LAST = 24
#: Mentions of one entity are dealt to so many keys when they meet its surrogate.
SALT = 16

# Titles by gender, first names by gender and script, letters by script and case.
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа")
TITLES = (*TITLES_M, *TITLES_F, "Dr", "Prof")
PARTICLES = ("van", "von", "der", "den", "de", "da", "di", "du", "la", "le", "el", "al", "bin", "ibn")
FIRST_M = ("Adrian", "Bruno", "Caspar", "Dario", "Emil", "Felix", "Gustav", "Hugo", "Ivo", "Jonas", "Karl", "Leo")
FIRST_F = ("Alma", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna", "Ida", "Julia", "Karin", "Lina")
FIRST_M_CYRILLIC = ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Леонид")
FIRST_F_CYRILLIC = ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Инна", "Клара", "Лидия", "Мария")
SYLLABLES = ("ba", "do", "fe", "ga", "ki", "lo", "ma", "ne", "po", "ri", "sa", "ti", "vo", "ze", "lu", "mi")
SYLLABLES_CYRILLIC = ("ба", "до", "фе", "га", "ки", "ло", "ма", "не", "по", "ри", "са", "ти", "во", "зе", "лу", "ми")
LOWER = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "àâäçèéêëîïñóôöùûü"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшщэюя"
HAN = "天地人山水火木金土日月星风云雨雪"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LOCAL = r"\p{L}\p{N}._%+-"
_NAME = r"\p{Lu}(?:\p{L}+|['’]\p{Lu}\p{L}+)(?:['’-]\p{L}+)*"
#: type: pattern, in order of preference where two begin at the same place.
PATTERNS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)*\.\p{{L}}{{2,}}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}(?:[!*#$%&]{0,3}[ .-])?)?\(\d{2,4}\)(?:[!*#$%&]{0,3} ?)\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,128})\b",
    "card": r"(?<![\d.])(?:(?:\d{4}[ -]){3}\d{4}|\d{13,19})(?![\d])",
    "name": rf"\b(?:{'|'.join(TITLES)})\.? (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_NAME}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity has one of these; the scan for them is cheap.
TRIGGER = rf"[@0-9]|AKIA|gh[pousr]_|sk-|\b(?:{'|'.join(TITLES)})\.? "

_random: dict[str, str] = {}


def configured_key(spark: SparkSession) -> str:
    """The session's key; without one, a random key of this application."""
    app = spark.sparkContext.applicationId
    return spark.conf.get(CONF, None) or _random.setdefault(app, secrets.token_hex(32))


def kind(entity: Column) -> Column:
    """The type of a detected string; null for numbers that fail their check."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        whole = entity.rlike(f"^(?:{pattern})$")
        if name == "card":
            whole &= F.call_function("luhn_check", F.regexp_replace(entity, "[ -]", ""))
        out = F.when(whole, F.lit(name)).otherwise(out)
    return out


def _chars(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.lit(1)))


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), (n % len(alphabet)) + 1, F.lit(1))


def _choose(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), n % len(values))


def _number(stream: Column, i: Column) -> Column:
    """The i-th 16-bit number of a stream of 64 that is then repeated."""
    return F.conv(F.substring(stream, (i % 64) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _swap(c: Column, n: Column) -> Column:
    """Another character of the same kind, case and script."""
    return (
        F.when(c.rlike("[0-9]"), _pick("0123456789", n))
        .when(c.rlike("[a-z]"), _pick(LOWER, n))
        .when(c.rlike("[A-Z]"), _pick(LOWER.upper(), n))
        .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), _pick(CYRILLIC.upper(), n)).otherwise(_pick(CYRILLIC, n)))
        .when(c.rlike(r"\p{Lu}"), _pick(ACCENTED.upper(), n))
        .when(c.rlike(r"\p{Ll}"), _pick(ACCENTED, n))
        .when(c.rlike(r"\p{L}"), _pick(HAN, n))
        .otherwise(c)
    )


def _swapped(x: Column, stream: Column, keep) -> Column:
    """x with its letters and digits swapped but at the places (from 0) where keep holds."""
    return F.array_join(F.transform(_chars(x), lambda c, i: F.when(keep(i), c).otherwise(_swap(c, _number(stream, i)))), "")


def _ip(x: Column, stream: Column, attempt: Column) -> Column:
    def octet(o: Column, i: Column) -> Column:
        n = _number(stream, i)
        fitting = F.when(F.length(o) == 3, 100 + n % 156).when(F.length(o) == 2, 10 + n % 90).otherwise(1 + n % 9)
        return F.when(attempt >= RELAXED, 1 + n % 254).otherwise(fitting).cast("string")

    return F.array_join(F.transform(F.split(x, r"\."), octet), ".")


def _card(x: Column, stream: Column) -> Column:
    """A number with the same first digit and separators whose last digit makes the check right."""
    body = _swapped(F.substring(x, F.lit(1), F.length(x) - 1), stream, lambda i: i == 0)
    digits = F.reverse(_chars(F.regexp_replace(body, "[ -]", "")))
    doubled = lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    values = F.transform(digits, lambda c, i: doubled(c.cast("int"), i))
    total = F.aggregate(values, F.lit(0), lambda a, b: a + b)
    return F.concat(body, F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _secret(x: Column, stream: Column) -> Column:
    hexes = lambda alphabet: F.array_join(F.transform(_chars(x), lambda c, i: _pick(alphabet, _number(stream, i))), "")
    prefix = F.length(F.regexp_extract(x, "^(AKIA|gh[pousr]_|sk-)", 1))
    other = _swapped(x, stream, lambda i: i < prefix)
    return F.when(prefix > 0, other).when(x == F.upper(x), hexes("0123456789ABCDEF")).otherwise(hexes("0123456789abcdef"))


def _email(x: Column, stream: Column, attempt: Column) -> Column:
    """Another address of the same length and top-level domain; after RELAXED draws with more letters in front."""
    tail = F.length(x) - F.length(F.regexp_extract(x, r"\.[^.@]+$", 0))
    more = F.sequence(F.lit(1), F.greatest(F.lit(1), attempt - RELAXED + 1))
    front = F.array_join(F.transform(more, lambda i: _pick(LOWER, _number(stream, 60 - i))), "")
    return F.concat(F.when(attempt >= RELAXED, front).otherwise(F.lit("")), _swapped(x, stream, lambda i: i >= tail))


def _part_of_name(of: Column, x: Column, stream: Column, attempt: Column) -> Column:
    """A family name of 3 syllables and one more for each draw, or a first name of the gender, in lower case."""
    cyrillic, n = x.rlike(r"\p{IsCyrillic}"), _number(stream, F.lit(0))
    syllables = lambda count: F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.when(cyrillic, _choose(SYLLABLES_CYRILLIC, _number(stream, i))).otherwise(_choose(SYLLABLES, _number(stream, i)))), "")
    woman = (of == "first_f") | ((of == "first_n") & (n % 2 == 0))
    first = F.when(cyrillic & woman, _choose(FIRST_F_CYRILLIC, n)).when(cyrillic, _choose(FIRST_M_CYRILLIC, n)).when(woman, _choose(FIRST_F, n)).otherwise(_choose(FIRST_M, n))
    first = F.when(attempt > 0, F.concat(first, syllables(F.greatest(F.lit(1), attempt)))).otherwise(first)
    return F.lower(F.when(of == "family", syllables(3 + attempt)).otherwise(first))


def surrogate(of: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The attempt-th surrogate of an entity of a type."""
    seed = F.concat_ws("\0", F.lit(key), of, entity, attempt.cast("string"))
    stream = F.concat(F.sha2(F.concat(F.lit("0"), seed), 512), F.sha2(F.concat(F.lit("1"), seed), 512))
    exchange = F.when(attempt < RELAXED, F.locate("555", entity)).otherwise(F.lit(0))
    phone = _swapped(entity, stream, lambda i: (exchange > 0) & (i >= exchange - 1) & (i < exchange + 2))
    return (
        F.when(attempt >= LAST, F.concat(of, F.lit("-"), F.substring(stream, 1, 24)))
        .when(of == "email", _email(entity, stream, attempt))
        .when(of == "ip", _ip(entity, stream, attempt))
        .when(of == "phone", phone)
        .when(of == "card", _card(entity, stream))
        .when(of == "secret", _secret(entity, stream))
        .when(of.isin("family", "first_f", "first_m", "first_n"), _part_of_name(of, entity, stream, attempt))
        .when(of == "iban", _swapped(entity, stream, lambda i: i < 2))
        .otherwise(_swapped(entity, stream, lambda i: F.lit(False)))
    )


def assigned(entities: DataFrame, key: str, tasks: int = 8) -> DataFrame:
    """of, entity, surrogate for distinct (of, entity): all surrogates differ and none is an entity."""
    entities = materialize(entities.repartition(tasks, "of", "entity"), "pii-entities")
    pending, fixed = entities.withColumn("attempt", F.lit(0)), None
    while True:
        dealt = pending.repartition(tasks, "of", "entity")
        drawn = materialize(dealt.withColumn("surrogate", surrogate(F.col("of"), F.col("entity"), F.col("attempt"), key)), "pii-drawn")
        least = drawn.groupBy(F.col("of").alias("l_of"), F.col("surrogate").alias("l_surrogate")).agg(F.min("entity").alias("winner"))
        taken = entities.select(F.col("of").alias("l_of"), F.col("entity").alias("l_surrogate"))
        if fixed is not None:
            taken = taken.unionAll(fixed.select("of", "surrogate"))
        same = ["l_of", "l_surrogate"]
        free = least.join(taken.distinct(), same, "left_anti")
        won = drawn.join(free, (F.col("of") == F.col("l_of")) & (F.col("surrogate") == F.col("l_surrogate")) & (F.col("entity") == F.col("winner")), "left")
        won = materialize(won.select("of", "entity", "attempt", "surrogate", F.col("winner").isNotNull().alias("good")), "pii-won")
        good = won.filter("good").select("of", "entity", "surrogate")
        fixed = good if fixed is None else fixed.unionAll(good)
        pending = won.filter("not good").select("of", "entity", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return fixed


def _title(name: Column) -> Column:
    return F.regexp_extract(name, rf"^(?:{'|'.join(TITLES)})\.?(?= )", 0)


def _words(name: Column) -> Column:
    """A detected name's words behind its title."""
    return F.split(F.substring(name, F.length(_title(name)) + 2, F.length(name)), " ")


def _family(name: Column) -> Column:
    return F.element_at(_words(name), -1)


def _first(name: Column) -> Column:
    """The first name, or empty text: the first of several words if it isn't a particle."""
    w = _words(name)
    return F.when((F.size(w) > 1) & F.get(w, F.lit(0)).rlike(r"^\p{Lu}"), F.get(w, F.lit(0))).otherwise(F.lit(""))


def slots(of: Column, mention: Column) -> Column:
    """The entities that a mention stands for: slot, of, canon; one without a type if it is none."""
    slot = lambda n, kind, canon: F.struct(F.lit(n).alias("slot"), kind.cast("string").alias("kind"), canon.cast("string").alias("canon"))
    digits = F.regexp_replace(mention, "[^0-9]", "")
    canon = (
        F.when(of == "email", F.lower(mention)).when(of == "phone", F.substring(digits, F.greatest(F.lit(1), F.length(digits) - 9), F.lit(10)))
        .when(of.isin("ssn", "card"), digits).when(of == "iban", F.regexp_replace(mention, " ", "")).otherwise(mention)
    )
    bare = F.regexp_replace(_title(mention), r"\.", "")
    gender = F.when(bare.isin(*TITLES_F), F.lit("first_f")).when(bare.isin(*TITLES_M), F.lit("first_m")).otherwise(F.lit("first_n"))
    whole = F.array(slot(0, F.lit("family"), F.lower(_family(mention))), slot(1, gender, F.lower(_first(mention))))
    return F.when(of == "name", F.filter(whole, lambda x: x["canon"] != "")).otherwise(F.array(slot(0, of, canon)))


def _filled(mention: Column, made: Column, kind: str) -> Column:
    """mention with its last characters of a kind replaced by those of made, in order."""
    only = lambda x: F.regexp_replace(x, f"[^{kind}]", "")
    before = F.length(only(mention)) - F.length(made)
    at = lambda i: F.length(only(F.substring(mention, F.lit(1), i + 1))) - before
    return F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c.rlike(f"[{kind}]") & (at(i) > 0), F.substring(made, at(i), F.lit(1))).otherwise(c)), "")


def _cased(word: Column, made: Column) -> Column:
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(made)).otherwise(F.initcap(made))


def rendered(of: Column, mention: Column, made: Column, first: Column) -> Column:
    """The surrogate of a mention's entity in the mention's format."""
    upper = F.transform(_chars(mention), lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substring(made, i + 1, F.lit(1)))).otherwise(F.substring(made, i + 1, F.lit(1))))
    email = F.when(F.length(mention) == F.length(made), F.array_join(upper, "")).otherwise(made)
    return (
        F.when(made.startswith(F.concat(of, F.lit("-"))), made).when(of == "email", email).when(of.isin("phone", "ssn", "card"), _filled(mention, made, "0-9")).when(of == "iban", _filled(mention, made, "A-Z0-9"))
        .when(of == "name", F.concat(_title(mention), F.lit(" "), _renamed(mention, made, first))).otherwise(made)
    )


def _renamed(mention: Column, family: Column, first: Column) -> Column:
    """The words behind a name's title: first and family name are replaced, what stands between them stays."""
    w = _words(mention)
    new = F.transform(w, lambda x, i: F.when(i == F.size(w) - 1, _cased(x, family)).when((i == 0) & x.rlike(r"^\p{Lu}"), _cased(x, first)).otherwise(x))
    return F.array_join(new, " ")


def _bare(of: Column, mention: Column, family: Column, first: Column) -> Column:
    """(find, put) of the forms that a name may have without its title, the longest first."""
    pair = lambda find, put: F.struct((-F.length(find)).alias("order"), find.alias("find"), put.alias("put"))
    whole = F.when(_first(mention) != "", pair(F.array_join(_words(mention), " "), _renamed(mention, family, first)))
    forms = F.array_compact(F.array(whole, pair(_family(mention), _cased(_family(mention), family))))
    return F.when((of == "name") & family.isNotNull(), forms).otherwise(F.array().cast("array<struct<order:int,find:string,put:string>>"))


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with text's entities replaced and n_entities, the number of replaced places."""
    key = key or configured_key(docs.sparkSession)
    text, tasks = F.col("text"), partitions(docs.sparkSession, docs)
    found = F.when(text.rlike(TRIGGER), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    scanned = materialize(docs.withColumn("__found", found).withColumn("__row", F.monotonically_increasing_id()), "pii-scanned")
    some = F.coalesce(F.size("__found"), F.lit(0)) > 0
    mentions = scanned.filter(some).select("__row", F.posexplode("__found").alias("pos", "mention"))
    mentions = mentions.withColumn("of", kind(F.col("mention"))).withColumn("s", F.explode(slots(F.col("of"), F.col("mention"))))
    # A title without gender takes that of another mention of the first name in the document.
    known = F.min("s.kind").over(Window.partitionBy("__row", F.col("s.slot"), F.col("s.canon")))
    parts = mentions.select("__row", "pos", "mention", "of", "s.slot", "s.canon", F.when(F.col("s.kind") == "first_n", known).otherwise(F.col("s.kind")).alias("kind"))
    parts = materialize(parts, "pii-found")
    named = assigned(parts.filter("kind is not null").select(F.col("kind").alias("of"), F.col("canon").alias("entity")).distinct(), key, tasks)
    named = named.select(F.col("of").alias("n_of"), F.col("entity").alias("n_entity"), "surrogate", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("n_salt"))
    salt = F.pmod(F.xxhash64("__row"), F.lit(SALT)).cast("int")
    joined = parts.join(named, (F.col("kind") == F.col("n_of")) & (F.col("canon") == F.col("n_entity")) & (salt == F.col("n_salt")), "left")
    of_slot = lambda n: F.max(F.when(F.col("slot") == n, F.col("surrogate")))
    places = joined.repartition(tasks, "__row").groupBy("__row", "pos").agg(F.max("mention").alias("mention"), F.max("of").alias("of"), of_slot(0).alias("made"), of_slot(1).alias("first"))
    args = [F.col(c) for c in ("of", "mention", "made", "first")]
    places = places.select("__row", "pos", "made", F.coalesce(rendered(*args), "mention").alias("as"), _bare(*args).alias("bare"))
    lists = places.groupBy("__row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "as"))), lambda p: p["as"]).alias("__as"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bare")))).alias("__bare"), F.count("made").alias("__n")
    )
    lists = lists.withColumnRenamed("__row", "__of")
    whole_word = lambda x: F.concat(F.lit(r"(?<![\p{L}'’-])\Q"), x, F.lit(r"\E(?![\p{L}-]|['’]\p{Lu})"))
    other = lambda x: F.aggregate(F.col("__bare"), x, lambda done, n: F.regexp_replace(done, whole_word(n["find"]), n["put"]))
    between = F.split(text, ANY, -1)
    renewed = F.array_join(F.transform(between, lambda x, i: F.concat(other(x), F.coalesce(F.get(F.col("__as"), i), F.lit("")))), "")
    touched = scanned.filter(some).join(lists, F.col("__row") == F.col("__of"))
    touched = touched.select(*[F.col(c) if c != "text" else renewed.alias("text") for c in docs.columns], F.col("__n").alias("n_entities"))
    return touched.unionAll(scanned.filter(~some).select(*docs.columns, F.lit(0).cast("long").alias("n_entities")))
