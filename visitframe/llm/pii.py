"""PII surrogates: found entities get keyed replacements of their own kind.

Kinds: e-mail addresses, IPv4 addresses, payment cards (Luhn), phone numbers,
and names after a title. An entity is its kind with a normal form (an address
in lower case, the digits of a card, the last ten of a phone number, a name without its
title), so it keeps one surrogate in all documents and notations (coreference). A surrogate is
drawn from a keyed digest of kind, normal form and attempt:

* address: same length pattern of letters and digits, at a reserved domain;
* IPv4: an address of the private range 10.0.0.0/8, after three clashes of the reserved 240.0.0.0/4;
* card: same issuer digit and length, right check digit, written as found;
* phone: the same country code, an area code and the 555 exchange (after three clashes another
  one), written as found;
* name: of the title's gender and of the letters' script (after three clashes a further family
  part of syllables joins, one syllable more with each attempt, so names do not run out).

Collision check: surrogates of one kind must be distinct and none may be an
entity of the corpus. Losers of a clash draw again, the least normal form wins; so
distinct entities stay distinct. All on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.llm.common import let, written

KEY = "visitframe"
KINDS = ("email", "ipv4", "card", "phone", "name")
# Titles by gender and given names and family names by script.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа")
NEUTRAL = ("Dr", "Prof")
GIVEN = {
    ("m", "latin"): ("James", "Peter", "Lukas", "Hugo", "Marco", "Simon", "Oscar", "Felix", "Adam", "Victor", "Bruno", "Martin"),
    ("f", "latin"): ("Anna", "Clara", "Julia", "Laura", "Maria", "Nora", "Elena", "Sofia", "Emma", "Alice", "Vera", "Ines"),
    ("n", "latin"): ("Robin", "Alex", "Kim", "Sascha", "Noel", "Jules", "Charlie", "Andrea", "Sam", "Chris", "Dominique", "Toni"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Олег", "Павел", "Антон", "Денис"),
    ("f", "cyrillic"): ("Анна", "Ольга", "Мария", "Елена", "Ирина", "Дарья"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Слава", "Шура", "Тоня"),
}
FAMILY = {
    "latin": ("Arden", "Berg", "Costa", "Duval", "Ekman", "Fischer", "Garner", "Holm", "Ibarra", "Jansen", "Keller", "Lorente", "Moreau", "Novak", "Olsen", "Perrin", "Quist", "Romero", "Stein", "Torres", "Ullman", "Vidal", "Weber", "Zeller"),
    "cyrillic": ("Белов", "Волков", "Громов", "Дымов", "Зимин", "Котов", "Лавров", "Морозов", "Орлов", "Попов", "Серов", "Чернов"),
}
#: 16 consonants, 4 vowels and the ending of a drawn family part: six bits of the digest are a syllable.
SYLLABLES = {"latin": ("bcdfghklmnprstvz", "aeio", "n"), "cyrillic": ("бвгджзклмнпрстфх", "аеио", "в")}
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}+"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
#: 4-6-5 digits, or groups of four; the check digit decides.
CARD = r"(?<![0-9])(?:3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7})(?![0-9])"
#: A country code and up to 15 digits in all, or the 3-3-4 form without one.
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+[1-9](?:[ .-]?\(?[0-9]\)?){6,14}(?![0-9])"
    r"|(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]))"
)
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
TITLE = "|".join(sorted({*MALE, *FEMALE, *NEUTRAL}, key=len, reverse=True))
NAME = rf"(?<!\p{{L}})(?:{TITLE})\.?[  ]+\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
ANY = f"(?:{EMAIL})|(?:{IPV4})|(?:{CARD})|(?:{PHONE})|(?:{NAME})"
#: A found piece of letters alone is a later mention of a name, see ``mentioned``.
WORDS = r"^\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?$"
#: Every entity holds a digit, an at sign or a title: a text without them is passed over.
CUE = rf"[0-9@]|(?<!\p{{L}})(?:{TITLE})(?!\p{{L}})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Sum of the Luhn rule over a string of digits, check digit included."""
    n = F.length(digits)

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda a, x: a + x)


def kind_of(piece: Column) -> Column:
    """Kind of a found piece; NULL for digits that are no card."""
    digits = _digits(piece)
    card = F.length(digits).between(13, 19) & (F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(1) % 10 == 0)
    return (
        F.when(piece.rlike(f"^(?:{EMAIL})$"), "email")
        .when(piece.rlike(f"^(?:{IPV4})$"), "ipv4")
        .when(piece.rlike(f"^(?:{CARD})$") & card, "card")
        .when(piece.rlike(f"^(?:{PHONE})$"), "phone")
        .when(piece.rlike(f"^(?:{NAME})$") | piece.rlike(WORDS), "name")
    )


def _gender(piece: Column) -> Column:
    title = F.regexp_extract(piece, rf"^({TITLE})", 1)
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def _bare_name(piece: Column) -> Column:
    return F.regexp_replace(piece, rf"^(?:{TITLE})\.?[  ]+", "")


def normal_form(kind: Column, piece: Column) -> Column:
    """What makes two findings one entity; of a name this is only its own wording, see ``resolved``.

    A phone number is its country code and the rest; in North America the code
    may be left out, so there the last ten digits are the entity.
    """
    digits = _digits(piece)
    country = F.regexp_extract(digits, COUNTRY, 1)
    rest = F.substring(digits, F.length(country) + 1, F.length(digits))
    abroad = piece.startswith("+") & ~((country == "1") & (F.length(rest) == 10))
    return (
        F.when(kind == "email", F.lower(piece))
        .when(kind == "ipv4", piece)
        .when(kind == "card", digits)
        .when((kind == "phone") & abroad, F.concat_ws(":", country, rest))
        .when(kind == "phone", F.right(digits, F.lit(10)))
        .otherwise(F.lower(_bare_name(piece)))
    )


def mentioned(parts: Column) -> Column:
    """``parts`` (text and findings in turn) with later mentions of titled names as further findings.

    A document that names "Mr. John Smith" also means that person by "John Smith" and by "Smith".
    """
    names = F.array_compact(
        F.transform(parts, lambda p, i: F.when((i % 2 == 1) & p.rlike(f"^(?:{NAME})$"), _bare_name(p)))
    )
    words = F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n, F.substring_index(n, " ", -1)))))
    longest = F.array_sort(F.filter(words, lambda w: F.length(w) > 2), lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})"))

    def cut(found: Column) -> Column:
        return F.flatten(
            F.transform(
                parts,
                lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(F.split(F.regexp_replace(p, found, F.lit("\x01$0\x01")), F.lit("\x01"), -1)),
            )
        )

    return F.when(F.size(longest) > 0, let(pattern, cut)).otherwise(parts)


def resolved(found: DataFrame) -> DataFrame:
    """Findings with the person that each name means, as ``normal``: gender, script and name.

    In a document a surname means the person of that surname who is named in
    full there: one whose gender fits the title, the first of several. Without
    such a person it is an entity of its own. An untitled or neutral mention
    takes the gender that the document's other mentions of the person show,
    then, for full names, the only one that any document shows.
    """
    others, names = found.where("kind <> 'name'"), found.where("kind = 'name'")
    names = names.withColumns({"own": _gender(F.col("piece")), "surname": F.substring_index("normal", " ", -1), "full": F.col("normal").contains(" ")})
    named = F.when(F.col("full"), F.struct("n", "normal"))
    people = names.groupBy("_row", "surname").agg(
        F.min(named).alias("any"), F.min(F.when(F.col("own") != "f", named)).alias("he"), F.min(F.when(F.col("own") != "m", named)).alias("she")
    )
    meant = names.join(people, ["_row", "surname"])
    who = F.when(F.col("own") == "m", F.col("he.normal")).when(F.col("own") == "f", F.col("she.normal")).otherwise(F.col("any.normal"))
    meant = meant.withColumn("person", F.when(F.col("full"), F.col("normal")).otherwise(F.coalesce(who, F.col("normal"))))

    def only(prefix: str) -> Column:
        m, f = F.col(f"{prefix}_m"), F.col(f"{prefix}_f")
        return F.when(m & ~f, "m").when(f & ~m, "f")

    def shown(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.max(F.col("own") == g).alias(f"{prefix}_{g}") for g in ("m", "f")])

    meant = written(meant.select("_row", "n", "kind", "piece", "own", "person"), "meant")
    full = meant.where(F.col("person").contains(" "))
    genders = meant.join(shown(meant, ["_row", "person"], "here"), ["_row", "person"]).join(shown(full, ["person"], "ever"), "person", "left")
    gender = F.when(F.col("own") != "n", F.col("own")).otherwise(F.coalesce(only("here"), only("ever"), F.lit("n")))
    script = F.when(F.col("person").rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    told = genders.select("_row", "n", "kind", "piece", F.concat_ws(":", gender, script, "person").alias("normal"))
    return others.select(*told.columns).unionByName(told)


def _number(digest: Column, place: int, modulus: int) -> Column:
    """A number below ``modulus`` from 12 hex digits of the digest."""
    return F.pmod(F.conv(F.substring(digest, place, 12), 16, 10).cast("long"), F.lit(modulus))


def _digit_string(digest: Column) -> Column:
    """36 decimal digits of the digest."""
    return F.concat(*[F.lpad(_number(digest, 1 + 12 * k, 10**9).cast("string"), 9, "0") for k in range(4)])


def _pick(names: tuple[str, ...], digest: Column, place: int) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (_number(digest, place, len(names)) + 1).cast("int"))


def _syllables(script: str, digest: Column, place: int, count: Column) -> Column:
    """``count`` syllables (8 at most) from the 48 bits at ``place``, then the ending."""
    consonants, vowels, ending = SYLLABLES[script]
    number = _number(digest, place, 1 << 48)
    parts = [
        F.when(
            F.lit(k) < count,
            F.concat(
                F.substring(F.lit(consonants), (F.shiftright(number, 6 * k).bitwiseAND(F.lit(15)) + 1).cast("int"), F.lit(1)),
                F.substring(F.lit(vowels), (F.shiftright(number, 6 * k + 4).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)),
            ),
        ).otherwise("")
        for k in range(8)
    ]
    return F.concat(*parts, F.lit(ending))


def surrogate(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, normal, attempt.cast("string"), F.lit(key)), 256)
    digits = _digit_string(digest)
    local = F.substring_index(normal, "@", 1)
    # Letters for letters and digits for digits, place by place.
    drawn = F.split(F.concat(digits, F.reverse(digits)), "")
    alike = F.array_join(
        F.transform(
            F.split(local, ""),
            lambda c, i: F.when(c.rlike("[0-9]"), F.get(drawn, F.pmod(i, F.lit(72)).cast("int")))
            .when(
                c.rlike("[a-z]"),
                F.substring(
                    F.lit("abcdefghijklmnopqrstuvwxyz"),
                    (F.pmod(F.get(drawn, F.pmod(i * 2, F.lit(72)).cast("int")).cast("int") * 10 + F.get(drawn, F.pmod(i * 2 + 1, F.lit(72)).cast("int")).cast("int"), F.lit(26)) + 1).cast("int"),
                    F.lit(1),
                ),
            )
            .otherwise(c),
        ),
        "",
    )
    # A short local part has few values of its pattern: the domain tells more of them apart.
    email = F.concat(alike, F.lit("@m"), F.lower(F.substring(digest, 60, 4)), F.lit(".example.org"))
    # The small ranges come first; who clashes there draws from a large one.
    block = F.when(attempt < 3, F.lit(10)).otherwise(_number(digest, 37, 16) + 240)
    ipv4 = F.concat_ws(".", block, _number(digest, 1, 256), _number(digest, 13, 256), _number(digest, 25, 256))
    size = F.length(normal)
    body = F.concat(F.substring(normal, 1, 1), F.substring(digits, F.lit(1), size - 2))
    rest = F.pmod(-luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(body, rest)
    exchange = F.when(attempt < 3, F.lit("555")).otherwise((_number(digest, 37, 800) + 200).cast("string"))
    country = F.substring(normal, F.lit(1), F.greatest(size - 10, F.lit(0)))
    phone = F.concat(country, F.lpad((_number(digest, 1, 800) + 200).cast("string"), 3, "0"), exchange, F.lpad(_number(digest, 13, 10**4).cast("string"), 4, "0"))
    phone = F.substring(phone, F.lit(1), size)
    far = F.split(normal, ":")
    rest = F.concat((_number(digest, 1, 9) + 1).cast("string"), F.substring(digits, F.lit(10), F.length(F.get(far, F.lit(1))) - 1))
    phone = F.when(F.size(far) > 1, F.concat_ws(":", F.get(far, F.lit(0)), rest)).otherwise(phone)
    parts = F.split(normal, ":", 3)
    names = F.lit(None).cast("string")
    for (gender, script), given in GIVEN.items():
        family = FAMILY[script]
        first = _pick(given, digest, 1)
        ending = F.when((F.lit(gender) == "f") & (F.lit(script) == "cyrillic"), "а").otherwise("")
        further = F.when(attempt < 3, "").otherwise(F.concat(F.lit("-"), _syllables(script, digest, 37, attempt - 1)))
        last = F.concat(_pick(family, digest, 13), F.lit("-"), _pick(family, digest, 25), further, ending)
        one = F.when(F.instr(parts[2], " ") > 0, F.concat_ws(" ", first, last)).otherwise(last)
        names = F.when((parts[0] == gender) & (parts[1] == script), one).otherwise(names)
    full = F.concat_ws(":", parts[0], parts[1], F.lower(names))
    return (
        F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "card", card).when(kind == "phone", phone).otherwise(full)
    )


def written_like(kind: Column, piece: Column, normal: Column) -> Column:
    """The surrogate in the notation of the found piece."""
    # Digit by digit into the places of the old ones; a country code stays.
    old = _digits(piece)
    local = F.substring_index(normal, ":", -1)
    code = F.substring(old, F.lit(1), F.length(old) - F.length(local))
    digits = F.split(F.concat(code, local), "")
    count = F.transform(F.split(piece, ""), lambda c: F.when(c.rlike("[0-9]"), 1).otherwise(0))
    places = F.transform(count, lambda c, i: F.aggregate(F.slice(count, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
    number = F.array_join(
        F.transform(F.split(piece, ""), lambda c, i: F.when(F.get(count, i) == 1, F.get(digits, F.get(places, i) - 1)).otherwise(c)), ""
    )
    title = F.regexp_extract(piece, rf"^((?:{TITLE})\.?[  ]+)", 1)
    whole = F.split(normal, ":", 3)[2]
    # A surname alone stays one, whoever it means.
    bare = F.when(F.instr(_bare_name(piece), " ") > 0, whole).otherwise(F.substring_index(whole, " ", -1))
    capital = F.array_join(F.transform(F.split(bare, " "), lambda w: F.array_join(F.transform(F.split(w, "-"), lambda x: F.initcap(x)), "-")), " ")
    upper = _bare_name(piece) == F.upper(_bare_name(piece))
    return (
        F.when(kind.isin("card", "phone"), number)
        .when(kind == "email", F.when(piece == F.upper(piece), F.upper(normal)).otherwise(normal))
        .when(kind == "ipv4", normal)
        .otherwise(F.concat(title, F.when(upper, F.upper(capital)).otherwise(capital)))
    )


def tasks_for(rows: int, each: int = 5_000) -> int:
    """Number of tasks that take ``each`` rows."""
    return max(1, -(-rows // each))


def _escaped(text: Column) -> Column:
    """Free character 1 to be a mark; ``_plain`` gives every text back."""
    safe = F.replace(F.replace(text, F.lit("\x03"), F.lit("\x03\x05")), F.lit("\x01"), F.lit("\x03\x04"))
    return F.when(text.contains("\x01") | text.contains("\x03"), safe).otherwise(text)


def _plain(text: Column) -> Column:
    back = F.replace(F.replace(text, F.lit("\x03\x04"), F.lit("\x01")), F.lit("\x03\x05"), F.lit("\x03"))
    return F.when(text.contains("\x03"), back).otherwise(text)


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, normal, surrogate) for distinct (kind, normal), without clashes.

    Each round draws for those that have none yet. A drawn value is refused if
    it is an entity itself, is taken, or if a smaller entity drew it too.
    """
    entities = written(entities.select("kind", "normal").distinct(), "entities")
    open_, done, attempt = entities, None, 0
    while True:
        dealt = open_.repartition(tasks_for(open_.count()), "kind", "normal")
        drawn = written(dealt.select("kind", "normal", surrogate(F.col("kind"), F.col("normal"), F.lit(attempt), key).alias("surrogate")), "drawn")
        taken = entities.select("kind", F.col("normal").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        winner = free.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal"))
        settled = written(winner.select("kind", "normal", "surrogate"), "settled")
        done = settled if done is None else done.unionByName(settled)
        open_ = written(open_.join(settled, ["kind", "normal"], "left_anti"), "open")
        if open_.isEmpty():
            return done
        attempt += 1
        if attempt > 1000:
            raise ValueError("more entities of a pattern than it has surrogates")


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """(id, text, n_<kind> for each kind): every row, its entities replaced.

    Texts without a digit, at sign or title pass in one scan; only the others
    are taken apart and shuffled, entity by entity, so neither a long text nor
    one entity in a third of all rows fills a task. NULL texts stay NULL, empty ones
    empty, repeated rows and NULL ids stay. Everything but the entities is kept,
    control characters too.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    marked = F.regexp_replace(_escaped(F.col("_text")), ANY, "\x01$0\x01")
    cue = F.coalesce(F.col("_text").rlike(CUE), F.lit(False))
    split = F.when(cue, F.split(marked, "\x01", -1))
    parted = rows.where(cue).select(F.monotonically_increasing_id().alias("_row"), "_id", split.alias("_parts"))
    parted = written(parted.withColumn("_parts", mentioned(F.col("_parts"))), "parted")
    pieces = parted.select("_row", F.posexplode("_parts").alias("n", "piece")).where(F.col("n") % 2 == 1)
    found = pieces.withColumn("kind", kind_of(F.col("piece"))).where(F.col("kind").isNotNull())
    found = written(found.withColumn("normal", normal_form(F.col("kind"), F.col("piece"))), "found")
    found = written(resolved(found), "resolved")
    table = surrogates(found, key)
    # Small rows, heavy expressions: dealt by number of rows, not by bytes.
    named = found.join(table, ["kind", "normal"]).repartition(tasks_for(found.count()), "_row", "n").select(
        "_row", F.struct("n", "kind", written_like(F.col("kind"), F.col("piece"), F.col("surrogate")).alias("new")).alias("e")
    )
    lists = named.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("e.n", "e.new"))).alias("_new"), *[F.sum((F.col("e.kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS])
    joined = parted.join(lists, "_row", "left")
    whole = F.array_join(F.transform("_parts", lambda p, i: F.coalesce(F.try_element_at("_new", i), p)), "")
    whole = _plain(whole)
    changed = joined.select(F.col("_id").alias(id_col), whole.alias("text"), *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS])
    plain = rows.where(~cue).select(F.col("_id").alias(id_col), F.col("_text").alias("text"), *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS])
    return plain.unionByName(changed)
