"""Personal data replaced by keyed surrogates, with DataFrame expressions only.

Found: e-mail and IP addresses, phone, card and social security numbers, IBANs, and names behind a title.
Each entity (its normal form: lower case, or its digits alone) gets one surrogate, whichever way and in
whichever document it is written:

- digits and letters change, separators and length stay; a phone number keeps its country code, a card its
  first digit and whether its check digit is right, an IBAN its country and right check digits;
- names keep titles, number of parts, script (Latin, Greek, Cyrillic) and, in all but the last part, the gender
  that the title tells; every part is an entity of its own, so "Mr. A B" and "Mr. B" agree. A part may have
  apostrophes and hyphens. An initial stays an initial; there are too few letters to keep initials apart;
- wherever a document that names "Mr. A B" writes "B", "B's", "B-like" or "A B" without a title, the same surrogates
  stand there, written as in the title's mention ("A" alone is too often a common word);
- e-mail addresses move to names under the reserved domain example.org.

The surrogate is a keyed digest (SHA-256) of type, normal form and attempt. Collision check: within a type no two
entities share a surrogate and no surrogate is an entity of the input; the losers of a collision try
again with the next attempt until none is left.

A null text stays null and has no entity. Documents without an entity pass unchanged. An empty table gives an
empty one; repeated rows are treated each; other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywarden.llm.base import checkpointed, fresh

# Formats. Each begins where no longer run of its characters could have begun, so a text
# is read in linear time.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
TITLES = {
    "m": ("Mr.", "Herr", "Monsieur", "Señor", "Sr.", "Г-н", "Κύριος"),
    "f": ("Mrs.", "Ms.", "Frau", "Madame", "Mme", "Señora", "Sra.", "Г-жа", "Κυρία"),
    "n": ("Dr.", "Prof."),
}
_TITLE = "(?:" + "|".join(t.replace(".", r"\.") for own in TITLES.values() for t in own) + ")"
# A part of a name: an initial, or a word with apostrophes and hyphens inside. Nobiliary particles join two parts.
_INITIAL = r"\p{Lu}\."
_PART = r"(?:\p{Lu}\.|\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+)"
_PARTICLES = "(?:(?:da|de|del|della|den|der|di|do|du|el|la|le|van|von|zu) ){0,3}+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63})+",
    "iban": _BEFORE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER,
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<!\d)\(\d{3}\) ?\d{3}[-.]\d{4}(?!\d)|(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": _BEFORE + r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})" + _AFTER,
    "ip": r"(?<![\d.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\.?\d)",
    "name": _BEFORE + "(?:" + _TITLE + " )+" + _PART + "(?: " + _PARTICLES + "(?!" + _TITLE + r"(?!\p{Ll}))" + _PART + ")*+",
}
# Words, with what apostrophes and hyphens join to them, and all between them.
_WORDS = r"[\p{L}\p{M}\p{N}]++(?:['’-][\p{L}\p{M}\p{N}]++)*+|[^\p{L}\p{M}\p{N}]++"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Syllables of names, and endings by gender; f for family names.
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fa", "ga", "ka", "la", "li", "lo", "ma", "mi", "na", "ni", "ra", "ri"),
    "greek": ("βα", "γα", "δη", "θε", "κα", "λα", "λι", "μα", "μι", "να", "νι", "πα", "ρα", "σο", "τα", "φι"),
    "cyrillic": ("ба", "ва", "га", "да", "ди", "ка", "ла", "ли", "ма", "ми", "на", "ни", "ра", "ри", "та", "то"),
}
ENDINGS = {
    "latin": {"m": "ron", "f": "lia", "n": "rin", "family": "mar"},
    "greek": {"m": "ρος", "f": "λια", "n": "ριν", "family": "δης"},
    "cyrillic": {"m": "рон", "f": "лия", "n": "рин", "family": "мар"},
}


def possible(text: Column) -> Column:
    """A cheap test that every text with a match passes: an @, a title, or a digit with six more characters
    of numbers behind it."""
    tests = [F.contains(text, F.lit("@")), text.rlike("[0-9][0-9A-Z.() +-]{6}")]
    tests += [F.contains(text, F.lit(title + " ")) for own in TITLES.values() for title in own]
    return reduce(Column.__or__, tests)


def kind_of(mention: Column) -> Column:
    """The first format that the mention has as a whole. Titles decide names, an @ an address."""
    whole = F.when(F.contains(mention, F.lit("@")), "email")
    for kind in ("iban", "ssn", "phone", "card", "ip"):
        whole = whole.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return whole.otherwise("name")


def titles_of(mention: Column) -> Column:
    """The titles in front of a name, with the blank behind them."""
    return F.regexp_extract(mention, f"^(?:{_TITLE} )+", 0)


def name_of(mention: Column) -> Column:
    return F.regexp_replace(mention, f"^(?:{_TITLE} )+", "")


def own_part(word: Column) -> Column:
    """Whether a word of a name gets a surrogate: not an initial and not a particle."""
    return word.rlike(r"^\p{Lu}") & ~word.rlike(f"^{_INITIAL}$")


def parts_of(mention: Column, kind: Column) -> Column:
    """Array of (type, norm): what needs a surrogate in a mention; NULL for a word of a name that needs none."""
    words = F.split(name_of(mention), " ")
    title = F.substring_index(mention, " ", 1)
    gender = F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("n")
    last = F.size(words) - 1

    def script(word: Column) -> Column:
        return F.when(word.rlike(r"\p{IsGreek}"), "greek").when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")

    def part(kind: Column, norm: Column) -> Column:
        return F.struct(kind.alias("type"), norm.alias("norm"))

    def of_name(word: Column, i: Column) -> Column:
        role = F.when(i == last, "family").otherwise(gender)
        return F.when(own_part(word), part(F.concat_ws("_", F.lit("name"), role, script(word)), F.lower(word)))

    names = F.transform(words, of_name)
    plain = F.when(kind.isin("email", "ip"), F.lower(mention)).otherwise(F.regexp_replace(mention, "[^A-Z0-9]", ""))
    return F.when(kind == "name", names).otherwise(F.array(part(kind, plain)))


def _luhn(digits: str) -> str:
    """SQL for the check digit of a string of digits."""
    d = f"try_cast(substring({digits}, length({digits}) - i + 1, 1) AS INT)"
    return f"((10 - aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN 2 * {d} - IF({d} > 4, 9, 0) ELSE {d} END) % 10) % 10)"


def surrogate(key: str) -> tuple[dict[str, Column], Column]:
    """Helper columns, and the surrogate from them and the columns type, norm and attempt."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), "type", "norm", F.col("attempt").cast("string")), 256)
    n = F.length("norm")

    def decimal(at: int) -> Column:
        return F.substring(F.lpad(F.conv(F.substring(h, at, 15), 16, 10), 20, "0"), 4, 17)

    digits = F.concat(decimal(1), decimal(16), decimal(31))
    letters = F.translate(h, "0123456789abcdef", "klmnopqrstuvwxyz")
    email = F.concat(F.substring(letters, 1, 10), F.lit("@"), F.substring(letters, 11, 8), F.lit(".example.org"))
    ip = F.concat_ws(".", *[(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") % 254 + 1).cast("string") for i in range(4)])
    code = F.when(n < 11, 0).when(F.substring("norm", 1, 1).isin("1", "7"), 1).otherwise(2)
    phone = F.concat(F.expr("substring(norm, 1, code)"), F.expr("substring(digits, 1, length(norm) - code)"))
    # Never a number that was issued: the first digit is 9.
    ssn = F.concat(F.lit("9"), F.substring(digits, 1, 8))
    body = F.expr("concat(substring(norm, 1, 1), substring(digits, 1, length(norm) - 2))")
    wrong = F.expr(f"IF(try_cast(substring(norm, length(norm), 1) AS INT) = {_luhn('substring(norm, 1, length(norm) - 1)')}, 0, 1)")
    card = F.expr(f"concat(body, ({_luhn('body')} + wrong) % 10)")
    tail = F.expr(
        "array_join(transform(sequence(5, length(norm)), i -> IF(substring(norm, i, 1) RLIKE '[0-9]', substring(digits, i - 4, 1), upper(substring(letters, i, 1)))), '')"
    )
    rest = "aggregate(split(concat(tail, substring(norm, 1, 2), '00'), ''), 0L, (a, c) -> CASE WHEN c = '' THEN a WHEN c RLIKE '[0-9]' THEN (a * 10 + try_cast(c AS BIGINT)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"
    iban = F.expr(f"concat(substring(norm, 1, 2), lpad(CAST(98 - {rest} AS STRING), 2, '0'), tail)")
    names = F.lit(None)
    for script, syllables in SYLLABLES.items():
        # One syllable more after every third attempt, so there are always names left.
        listed = ", ".join(f"'{x}'" for x in syllables)
        pieces = F.expr(f"transform(sequence(1, 3 + CAST(attempt / 3 AS INT)), i -> element_at(array({listed}), CAST(conv(substring(h, i, 1), 16, 10) AS INT) + 1))")
        for role, ending in ENDINGS[script].items():
            names = F.when(F.col("type") == f"name_{role}_{script}", F.initcap(F.concat(F.array_join(pieces, ""), F.lit(ending)))).otherwise(names)
    columns = {"h": h, "digits": digits, "letters": letters, "code": code, "body": body, "wrong": wrong, "tail": tail}
    chosen = F.when(F.col("type") == "email", email).when(F.col("type") == "ip", ip).when(F.col("type") == "phone", phone).when(F.col("type") == "ssn", ssn)
    chosen = chosen.when(F.col("type") == "card", card).when(F.col("type") == "iban", iban).otherwise(names)
    return columns, chosen


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """entities: distinct (type, norm). Returns (type, norm, surrogate), one-to-one within a type and apart
    from all norms."""
    columns, chosen = surrogate(key)
    taken = entities.select("type", F.col("norm").alias("taken"))
    pending, done = entities.withColumn("attempt", F.lit(0)), []
    while True:
        tried = pending
        for group in (("h", "digits", "letters", "code"), ("body", "wrong", "tail")):
            tried = tried.withColumns({name: columns[name] for name in group})
        tried = tried.withColumn("surrogate", chosen).select("type", "norm", "attempt", "surrogate", F.lower("surrogate").alias("taken"))
        free = tried.join(taken.unionByName(reduce(DataFrame.unionByName, [d.select("type", F.lower("surrogate").alias("taken")) for d in done])) if done else taken, ["type", "taken"], "left_anti")
        first = free.groupBy("type", F.col("taken").alias("won")).agg(F.min("norm").alias("norm"))
        result = checkpointed(tried.join(first.withColumn("held", F.lit(True)), ["type", "norm"], "left").select("type", "norm", "attempt", "surrogate", F.col("held").isNotNull().alias("held")))
        done.append(result.where("held").select("type", "norm", "surrogate"))
        pending = result.where("NOT held").select("type", "norm", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)


def filled(mention: str, payload: str) -> Column:
    """The mention with its letters and digits replaced, one by one, by those of the payload."""
    return F.expr(
        f"aggregate(regexp_extract_all({mention}, '[A-Z0-9]|[^A-Z0-9]', 0), named_struct('s', '', 'i', 1), "
        f"(a, c) -> IF(c RLIKE '[A-Z0-9]', named_struct('s', concat(a.s, substring({payload}, a.i, 1)), 'i', a.i + 1), named_struct('s', concat(a.s, c), 'i', a.i)), a -> a.s)"
    )


def _distinct_words(said: Column) -> Column:
    """A map from an array of (word, surrogate); of several surrogates of a word the smallest."""
    ordered = F.array_sort(F.array_distinct(said))
    return F.map_from_entries(F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1)["word"] != x["word"], F.lit(True))))


def untitled(pieces: Column, family: Column, given: Column) -> Column:
    """The pieces of a text between its mentions, with names that it has a title for elsewhere replaced too.
    family, given: maps from the words of those names to their surrogates."""

    def looked_up(names: Column, word: Column) -> Column:
        found = F.try_element_at(names, word)
        for stem in (F.regexp_replace(word, "['’]s$", ""), F.regexp_extract(word, r"^[\p{L}\p{M}\p{N}]+", 0)):
            found = F.coalesce(found, F.concat(F.try_element_at(names, stem), F.substring(word, F.length(stem) + 1, F.length(word))))
        return found

    def replacement(word: Column, gap: Column, following: Column) -> Column:
        # A given name counts only in front of another part of a name.
        full = (gap == " ") & F.coalesce(looked_up(family, following), F.try_element_at(given, following)).isNotNull()
        new = F.coalesce(looked_up(family, word), F.when(full, F.try_element_at(given, word)), word)
        return F.when(word.rlike(r"^\p{Lu}"), new).otherwise(word)

    def rewritten(words: Column) -> Column:
        return F.array_join(F.transform(words, lambda w, i: replacement(w, F.get(words, i + 1), F.get(words, i + 2))), "")

    split = F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(_WORDS), F.lit(0)))
    return F.when(F.size(family) + F.size(given) > 0, F.transform(split, rewritten)).otherwise(pieces)


def replaced(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> tuple[DataFrame, str]:
    """The documents with surrogates in their text and a column that counts the mentions by format (names: those
    behind a title); returns the frame and that column's name (changed if the frame has a column of that name)."""
    counted = fresh(docs, count_col)
    text = F.col(text_col)
    found = possible(text) & text.rlike(ANY)
    clean = docs.where(F.coalesce(~found, F.lit(True))).withColumn(counted, F.lit(0).cast("long"))
    names = {name: fresh(docs, "pii_" + name) for name in ("hash", "mentions", "pieces", "map", "family", "given")}
    hold = docs.where(found).withColumns(
        {names["hash"]: F.sha2(text, 256), names["mentions"]: F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), names["pieces"]: F.split(text, ANY, -1)}
    )
    in_text = hold.select(F.col(names["hash"]).alias("hash"), F.explode(F.array_distinct(names["mentions"])).alias("mention")).distinct()
    in_text = checkpointed(in_text)
    mentions = in_text.select("mention").distinct().withColumn("kind", kind_of(F.col("mention")))
    parts = mentions.select("mention", "kind", F.posexplode(parts_of(F.col("mention"), F.col("kind"))).alias("at", "part")).select("mention", "kind", "at", "part.type", "part.norm")
    parts = checkpointed(parts)
    surrogates = assigned(parts.where("type IS NOT NULL").select("type", "norm").distinct(), key)
    word = F.get(F.split(name_of(F.col("mention")), " "), F.col("at"))
    letter = F.upper(F.translate(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("initial"), word), 256), 1, 1), "0123456789abcdef", "abcdefghijklmnop"))
    kept = F.when(word.rlike(f"^{_INITIAL}$"), F.concat(letter, F.lit("."))).otherwise(word)

    def said(*roles: str) -> Column:
        """The words of a name with these roles (a role is empty in other kinds), with their surrogates."""
        words = F.filter("own", lambda o: o["role"].isin(*roles))
        return F.transform(words, lambda o: F.struct(o["word"].alias("word"), o["surrogate"].alias("surrogate")))

    chosen = (
        parts.join(surrogates, ["type", "norm"], "left")
        .withColumns({"surrogate": F.coalesce("surrogate", kept), "word": word, "role": F.split_part("type", F.lit("_"), F.lit(2))})
        .groupBy("mention", "kind")
        .agg(F.array_sort(F.collect_list(F.struct("at", "surrogate", "word", "role"))).alias("own"))
        .select("mention", "kind", F.transform("own", lambda o: o["surrogate"]).alias("own"), said("family").alias("family"), said("m", "f", "n").alias("given"))
        .withColumn("payload", F.array_join("own", " "))
        .select(
            "mention",
            F.when(F.col("kind").isin("email", "ip"), F.col("payload"))
            .when(F.col("kind") == "name", F.concat(titles_of(F.col("mention")), F.col("payload")))
            .otherwise(filled("mention", "payload"))
            .alias("new"),
            "family",
            "given",
        )
    )
    maps = in_text.join(chosen, "mention").groupBy("hash").agg(
        F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias(names["map"]),
        *[_distinct_words(F.flatten(F.collect_list(role))).alias(names[role]) for role in ("family", "given")],
    )
    maps = maps.withColumnRenamed("hash", names["hash"])
    joined = hold.join(maps, names["hash"])
    new = F.concat(F.transform(names["mentions"], lambda m: F.element_at(names["map"], m)), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(untitled(F.col(names["pieces"]), F.col(names["family"]), F.col(names["given"])), new, lambda p, m: F.concat(p, m)), "")
    done = joined.withColumn(text_col, rebuilt).withColumn(counted, F.size(names["mentions"]).cast("long"))
    return clean.unionByName(done.select(*clean.columns)), counted
