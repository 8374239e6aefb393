"""PII surrogates with DataFrame functions alone: entities get keyed, type-consistent replacements.

An entity's canonical form (digits of a number, lower-cased address, one part of a name) decides its surrogate, so all mentions
of it, in any format, stay together (coreference). Surrogates are drawn by a keyed SHA-256; a draw that equals another
surrogate or a canonical form found in the corpus is drawn again, so different entities stay different. Local parts, domains and
surnames grow with the draws. Kinds of fixed size whose space fills up get its free values one by one; where it has fewer than entities, all
entities of that form trade their canonical forms in a keyed cycle: still distinct and never their own. A mention's format is kept:
separators, case, length, country code, the Luhn check of a card number; a given name is replaced by one of the same gender and
script, a surname and a given name of no list by one of the same script, an initial by another letter.

Names are found by a common given name, a title or a label before them, or an address after them, in scripts that have capitals. A part of a
found name that stands alone in the same document is replaced like the name's; all replacements look at the original text alone, so no surrogate is replaced
again.

The key is a secret: an argument, or else the session's SECRET_SETTING. Where that is unset too, a session draws one of its own, under which
surrogates agree within the session only.

Null and empty texts stay as they are, with no entities. Rows are told apart by id and a 64-bit hash of the text, so rows may
be repeated, and may share an id or have none. All other columns are kept as they are.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandlake.llm.common import stored, table

#: The session's setting that holds the key. Spark hides settings of this name in its pages.
SECRET_SETTING = "spark.strandlake.pii.secret"
#: Draws of a surrogate; what they leave is placed by `placed` (a space that is nearly full).
DRAWS = 30
#: From each so many draws on, local parts and domains have a letter more.
GROW = 3

# Common given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Amelia Ana Anna Barbara Beatriz Camille Carmen Caroline Charlotte Claire Elisabeth Emily Emma Eva Françoise Gabriela Grace Greta Hannah Heike Helen Ingrid Isabel Isabelle Jennifer Jessica Julia Julie Karen Katharina Laura Léa Lena Linda Lisa Lucía Margaret Maria María Marie Mary Michelle Monika Monique Nancy Nathalie Olivia Patricia Petra Rebecca Rosa Sabine Sara Sarah Sofía Sophie Susan Ursula Valentina Victoria".split(),
    ("latin", "m"): "Albert Alejandro Alexander Andrew Antoine Carlos Charles Christian Daniel David Diego Edward Fernando François Frank George Günter Hans Henry Hugo James Jan Jason Javier Jean John Jorge José Joseph Juan Jürgen Karl Kevin Klaus Louis Lucas Luis Manuel Mark Martin Matthew Michael Miguel Oliver Pablo Paul Pedro Peter Philippe Pierre Richard Robert Stefan Stephen Thomas Walter William".split(),
    ("cyrillic", "f"): "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Αικατερίνη Βασιλική Ελένη Ιωάννα Μαρία Σοφία".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης".split(),
}
SYLLABLES = {
    "latin": "ba bel bor cal car den dor fal fen gar hal hol kel lan lin mar mel mor nel nor pel ral ren ros sel tal tor val ven wal wen zel".split(),
    "cyrillic": "ба бел бор вал вен гор дан дор зел кал кор лан лен мар мел мор нев нор пал рад рос сел тал тор".split(),
    "greek": "βα βελ γαλ δαν δορ ζελ καλ κορ λαν λεν μαρ μελ νορ παλ ραν ροσ σελ ταλ τορ φαν".split(),
}
ENDINGS = {"latin": "er", "cyrillic": "ов", "greek": "ης"}

# What stands before or inside names.
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Herr Frau Señor Señora Monsieur Madame Mme".split()
LABELS = "ame ontact atient uthor ustomer mployee igned ttn lient anager".split()  # after a first letter of either case
PARTICLES = "de la las los del di da do dos van von der den bin al".split()
ALPHABETS = {
    "latin": "".join(map(chr, range(65, 91))), "cyrillic": "".join(map(chr, range(0x410, 0x430))), "greek": "".join(chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2),
}

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
EMAIL = r"(?<![._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
SECRET = r"(?=[a-fA-F]*\d)[0-9a-fA-F]{32,}" + _END
IBAN = r"[A-Z]{2}\d{2}(?=[A-Z0-9]*\d)[A-Z0-9]{11,30}" + _END
IP = r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)"
CARD = r"(?<![.+-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})" + _END
SSN = r"(?<![.+-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"
PHONE = (
    r"(?<!\+)(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+[2-9]\d{0,2}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+[2-9]\d{0,2}(?: \d{2,4}){2,4}"
    r"|\+[2-9]\d{0,2}(?:-\d{2,4}){2,4}|\+[2-9]\d{7,14}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4} \d{3,4} \d{3,4})(?![\p{L}\p{N}]|-\d)"
)
_NAMES = sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n))
_CAPITAL = r"\p{Lu}[\p{L}'’-]*\p{L}"
_MIDDLE = rf"(?:(?:\p{{Lu}}\.|{'|'.join(PARTICLES)}) ){{0,3}}"
NAME = (
    rf"(?:(?=\p{{L}}+ \p{{L}})(?:{'|'.join(_NAMES)}|{'|'.join(n.upper() for n in _NAMES)}) {_MIDDLE}{_CAPITAL}"
    rf"|(?<=\b(?:{'|'.join(TITLES)})\.? ){_CAPITAL}(?: {_MIDDLE}{_CAPITAL})?"
    rf"|(?<=(?:{'|'.join(LABELS)}): ){_CAPITAL} {_MIDDLE}{_CAPITAL}"
    rf"|{_CAPITAL} {_MIDDLE}{_CAPITAL}(?= [<(][^\s<>()@]{{1,64}}@))" + _END
)
#: Every mention starts after no letter or digit; what it starts with tells what it can be.
ENTITY = _EDGE + rf"(?:{EMAIL}|(?=[0-9a-fA-F+(])(?:{SECRET}|{IP}|{CARD}|{SSN}|{PHONE})|(?=\p{{Lu}})(?:{IBAN}|{NAME}))"
#: A text's words, with or without inner marks, and what is between them.
WORD = r"[\p{L}\p{N}]+"
TOKEN = WORD + rf"(?:['’-]{WORD})*|[^\p{{L}}\p{{N}}]+"


def kind_of(mention: Column) -> Column:
    digits = F.length(F.regexp_replace(mention, r"\D", ""))
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(r"^[0-9a-fA-F]{32,}$"), "secret")
        .when(digits == 0, "name")
        .when(mention.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+$"), "iban")
        .when(mention.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(~mention.startswith("+") & (digits >= 13), "card")
        .otherwise("phone")
    )


def parts_of(kind: Column, mention: Column) -> Column:
    """The mention's canonical parts, (part, canon) each: a name has a given name (`first` if it is of no list) and a surname, an address its two sides."""
    part = lambda name, canon: F.struct((name if isinstance(name, Column) else F.lit(name)).alias("part"), canon.alias("canon"))
    lower = F.lower(mention)
    first = F.substring_index(lower, " ", 1)
    given = part(F.when(first.isin([n.lower() for n in _NAMES]), "given").otherwise("first"), first)
    surname = part("surname", F.substring_index(lower, " ", -1))
    return (
        F.when(kind == "email", F.array(part("local", F.substring_index(lower, "@", 1)), part("domain", F.substring_index(lower, "@", -1))))
        .when((kind == "name") & mention.contains(" "), F.array(given, surname))
        .when(kind == "name", F.array(surname))
        .when(kind.isin("phone", "card", "ssn"), F.array(part(kind, F.regexp_replace(mention, r"\D", ""))))
        .otherwise(F.array(part(kind, lower)))
    )


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def secret_of(spark: SparkSession, key: str | None = None) -> str:
    found = key or spark.conf.get(SECRET_SETTING, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(SECRET_SETTING, found)
    return found


def _noise(key: str, *of: Column) -> Column:
    """A keyed hash in hexadecimal digits, as long as any surrogate needs; the key stands inside and outside."""
    once = F.sha2(F.concat_ws("|", F.lit(key), *of), 256)
    return F.concat(*(F.sha2(F.concat_ws("|", F.lit(key), once, F.lit(i)), 256) for i in range(4)))


def _number(noise: Column, at: Column | int) -> Column:
    """A number below 65536 out of the noise at a place that wraps round."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substr(noise, (at * 4) % 252 + 1, F.lit(4)), 16, 10).cast("int")


def _like(canon: Column, noise: Column) -> Column:
    """Letters become letters and digits digits; everything else stays."""
    letters, hexes = F.array(*(F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz")), "0123456789"
    return F.array_join(
        F.transform(
            F.split(canon, ""),
            lambda c, i: F.when(c.rlike(r"\d"), F.substr(F.lit(hexes), _number(noise, i) % 10 + 1, F.lit(1))).when(c.rlike(r"\p{L}"), F.get(letters, _number(noise, i) % 26)).otherwise(c),
        ),
        "",
    )


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, the last of which isn't doubled."""
    def add(total: Column, x: Column) -> Column:
        d, i = x["d"], x["i"]
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i"))), F.lit(0), add)


def drawn(part: Column, canon: Column, draw: Column, key: str) -> Column:
    noise = _noise(key, part, canon, draw.cast("string"))
    digits = _like(canon, noise)
    first = lambda n: F.concat(F.substr(canon, F.lit(1), F.lit(n)), F.substr(digits, F.lit(n + 1)))
    # A card number keeps its first digit, and its Luhn check if the original passes: the last digit makes up for the sum.
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2), F.length(canon) - 2))
    checked = F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    card = F.when(_luhn_sum(canon) % 10 == 0, checked).otherwise(first(1))
    ip = F.concat_ws(".", (_number(noise, 0) % 223 + 1).cast("string"), *((_number(noise, i) % 256).cast("string") for i in (1, 2, 3)))
    script = script_of(canon)
    more = F.translate(F.substr(_noise(key, part, canon, draw.cast("string"), F.lit("more")), F.lit(1), F.floor(draw / GROW).cast("int")), "0123456789", "ghijklmnop")

    def surname(name: str) -> Column:
        syllables = F.array(*(F.lit(s) for s in SYLLABLES[name]))
        parts = F.transform(F.sequence(F.lit(0), F.lit(2) + F.floor(draw / 2)), lambda i: F.get(syllables, _number(noise, i) % len(SYLLABLES[name])))
        return F.concat(F.array_join(parts, ""), F.when(part == "surname", ENDINGS[name]).otherwise(""))

    labels = F.split(canon, r"\.")
    domain = F.concat_ws(".", F.concat(more, F.array_join(F.transform(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda x, j: _like(x, _noise(key, part, canon, draw.cast("string"), j.cast("string")))), ".")), F.element_at(labels, -1))
    return (
        F.when(part == "ip", ip)
        .when(part == "card", card)
        .when(part == "phone", F.when(F.length(canon) > 10, first_country(canon, digits)).otherwise(digits))
        .when(part == "iban", first(2))
        .when(part == "secret", F.substr(F.repeat(noise, 4), F.lit(1), F.length(canon)))
        .when(part == "domain", domain)
        .when(part == "local", F.concat(digits, more))
        .when(part.isin("surname", "first"), F.when(script == "cyrillic", surname("cyrillic")).when(script == "greek", surname("greek")).otherwise(surname("latin")))
        .otherwise(digits)
    )


def first_country(canon: Column, digits: Column) -> Column:
    """The digits before the last ten are the country code and stay."""
    n = F.length(canon) - 10
    return F.concat(F.substr(canon, F.lit(1), n), F.substr(digits, n + 1))


def given_names(spark: SparkSession, key: str) -> DataFrame:
    """(part, canon, surrogate): in each script and gender, a keyed cycle through the names, which has no fixed point and no collision."""
    rows = [("given", n.lower(), script, gender) for (script, gender), names in GIVEN.items() for n in sorted(set(names))]
    names = spark.createDataFrame(rows, "part string, canon string, script string, gender string")
    ring = Window.partitionBy("script", "gender").orderBy(F.sha2(F.concat(F.lit(key), "canon"), 256))
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return names.select("part", "canon", F.coalesce(F.lead("canon").over(ring), F.first("canon").over(whole)).alias("surrogate"))


def form_of(part: Column, canon: Column) -> Column:
    """Canons of one part and form can stand for each other."""
    pattern = F.regexp_replace(F.regexp_replace(canon, r"\d", "0"), r"\p{L}", "a")
    n = F.length(canon)
    return (
        F.when(part.isin("phone", "ssn"), F.concat(F.substr(canon, F.lit(1), F.greatest(n - 10, F.lit(0))), F.lit(":"), n.cast("string")))
        .when(part == "card", F.concat_ws(":", F.substr(canon, F.lit(1), F.lit(1)), n.cast("string"), (_luhn_sum(canon) % 10 == 0).cast("string")))
        .when(part == "iban", F.concat(F.substr(canon, F.lit(1), F.lit(2)), pattern))
        .when(part == "secret", n.cast("string"))
        .otherwise("")
    )


def placed(open_: DataFrame, found: DataFrame, done: DataFrame, taken: DataFrame, spark: SparkSession, key: str) -> DataFrame:
    """done and the canons that DRAWS draws left without a surrogate, which only happens where a large share of a space is used: so
    its values are no more than a small multiple of the canons found, and are listed. Then whole forms without a free value trade canons."""
    left = stored(open_.withColumn("form", form_of(F.col("part"), F.col("canon"))), spark)
    keyed = lambda c: F.sha2(F.concat(F.lit(key), c), 256)
    number = lambda c: F.row_number().over(Window.partitionBy("part").orderBy(keyed(c), c)).alias("_no")
    for row in left.where("part in ('phone', 'ssn')").groupBy("part", "form").count().collect():  # a row for each form that is nearly full
        prefix, n = row["form"].split(":")
        size = int(n) - len(prefix)
        values = spark.range(10**size).select(F.lit(row["part"]).alias("part"), F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), size, "0")).alias("surrogate"))
        free = values.join(taken, ["part", "surrogate"], "left_anti").orderBy(keyed(F.col("surrogate")), "surrogate").limit(row["count"])
        these = left.where((F.col("part") == row["part"]) & (F.col("form") == row["form"]))
        pairs = these.select("part", "canon", number(F.col("canon"))).join(free.select("part", "surrogate", number(F.col("surrogate"))), ["part", "_no"])
        done = done.unionByName(stored(pairs.select("part", "canon", "surrogate"), spark))
    full = left.join(done, ["part", "canon"], "left_anti").select("part", "form").distinct()
    every = found.where("part <> 'given'").withColumn("form", form_of(F.col("part"), F.col("canon"))).join(full, ["part", "form"], "left_semi")
    ring = Window.partitionBy("part", "form").orderBy(keyed(F.col("canon")), "canon")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    traded = stored(every.select("part", "canon", F.coalesce(F.lead("canon").over(ring), F.first("canon").over(whole)).alias("surrogate")), spark)
    return done.join(traded, ["part", "canon"], "left_anti").unionByName(traded)


def surrogates(found: DataFrame, spark: SparkSession, key: str | None = None) -> DataFrame:
    """found: distinct (part, canon) -> (part, canon, surrogate), different for different canons of a part, and none of them a canon
    unless the canon's form has too few values (see `placed`)."""
    key = secret_of(spark, key)
    given = given_names(spark, key).join(found, ["part", "canon"], "left_semi")
    open_ = found.where("part <> 'given'")
    taken = found.select("part", F.col("canon").alias("surrogate"))
    done: list[DataFrame] = []
    for draw in range(DRAWS):
        tried = open_.withColumn("surrogate", drawn(F.col("part"), F.col("canon"), F.lit(draw), key))
        ranked = tried.withColumn("place", F.row_number().over(Window.partitionBy("part", "surrogate").orderBy("canon")))
        free = ranked.join(taken.withColumn("hit", F.lit(True)), ["part", "surrogate"], "left")
        judged = stored(free.select("part", "canon", "surrogate", ((F.col("place") == 1) & F.col("hit").isNull()).alias("good")), spark)
        good = judged.where("good").select("part", "canon", "surrogate")
        done.append(good)
        open_ = judged.where("not good").select("part", "canon")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done).unionByName(given)
        taken = taken.unionByName(good.select("part", "surrogate"))
    return placed(open_, found, reduce(DataFrame.unionByName, done), taken, spark, key).unionByName(given)


def _in_format(mention: Column, digits: Column) -> Column:
    """digits in the places of the mention's digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda a, c: F.when(c.rlike(r"\d"), F.struct(F.concat(a["out"], F.substr(digits, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
    return F.aggregate(F.split(mention, ""), start, step, lambda a: a["out"])


def _initials(mention: Column, key: str) -> Column:
    """What stands between a name's first and last word. Initials move on in their alphabet by a number of steps that the name's other words
    decide, so different initials stay different."""
    middle = F.regexp_extract(mention, r"^\S+((?: \S+)*) \S+$", 1)
    whose = F.concat_ws(" ", F.substring_index(F.lower(mention), " ", 1), F.substring_index(F.lower(mention), " ", -1))

    def moved(w: Column) -> Column:
        letter, out = F.substr(w, F.lit(1), F.lit(1)), F.lit("A.")
        for letters in ALPHABETS.values():
            step = _number(_noise(key, F.lit("initial"), whose), 0) % (len(letters) - 1) + 1
            to = (F.instr(F.lit(letters), letter) - 1 + step) % len(letters) + 1
            out = F.when(F.lit(letters).contains(letter), F.concat(F.substr(F.lit(letters), to, F.lit(1)), F.lit("."))).otherwise(out)
        return F.when(w.endswith("."), out).otherwise(w)

    return F.when(middle == "", "").otherwise(F.array_join(F.transform(F.split(middle, " "), lambda w: F.when(w == "", w).otherwise(moved(w))), " "))


def rendered(kind: Column, mention: Column, parts: Column, key: str) -> Column:
    """The surrogate in the mention's format. parts: the surrogates of its parts in order."""
    one = F.get(parts, F.lit(0))
    two = F.get(parts, F.lit(1))
    upper = mention == F.upper(mention)
    cased = lambda word, new: F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(new)).otherwise(F.initcap(new))
    last = F.substring_index(mention, " ", -1)
    name = F.when(two.isNull(), cased(last, one)).otherwise(F.concat(cased(F.substring_index(mention, " ", 1), one), _initials(mention, key), F.lit(" "), cased(last, two)))
    return (
        F.when(kind == "email", F.concat(one, F.lit("@"), two))
        .when(kind == "name", name)
        .when(kind.isin("phone", "card", "ssn"), _in_format(mention, one))
        .when(kind == "iban", F.upper(one))
        .when((kind == "secret") & upper, F.upper(one))
        .otherwise(one)
    )


def followed(piece: Column, old: Column, new: Column) -> Column:
    """The piece, which holds no mention, with each capitalised word of `old` (lower-case parts of the document's names) in its own surrogate."""

    def word(w: Column) -> Column:
        to = F.initcap(F.get(new, (F.array_position(old, F.lower(w)) - 1).cast("int")))
        return F.when(w.rlike(r"^\p{Lu}") & F.array_contains(old, F.lower(w)), F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(to)).otherwise(to))

    def token(t: Column) -> Column:
        inside = F.array_join(F.transform(F.regexp_extract_all(t, F.lit(WORD + r"|[^\p{L}\p{N}]+"), F.lit(0)), lambda w: F.coalesce(word(w), w)), "")
        return F.coalesce(word(t), F.when(t.rlike(r"['’-]"), inside).otherwise(t))

    return F.array_join(F.transform(F.regexp_extract_all(piece, F.lit(TOKEN), F.lit(0)), token), "")


def with_surrogates(docs: DataFrame, spark: SparkSession, key: str | None = None) -> DataFrame:
    """docs with surrogates in text and a column n_entities; rows without entities as they are."""
    key = secret_of(spark, key)
    row = ["doc_id", "_pii_h"]
    lists = docs.select("doc_id", F.xxhash64("text").alias("_pii_h"), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("mentions")).where(F.size("mentions") > 0)
    lists = stored(lists.dropDuplicates(row), spark)  # equal rows have equal results
    mentions = lists.select(*row, F.posexplode("mentions").alias("at", "mention")).withColumn("kind", kind_of(F.col("mention")))
    parts = mentions.select(*row, "at", "mention", "kind", F.posexplode(parts_of(F.col("kind"), F.col("mention"))).alias("side", "p")).select(*row, "at", "mention", "kind", "side", "p.part", "p.canon")
    # Spark broadcasts the surrogates if they are small; else it splits the rows of an entity that many documents mention.
    chosen = stored(surrogates(parts.select("part", "canon").distinct(), spark, key), spark)
    joined = parts.join(chosen, ["part", "canon"])
    # A document's own mentions are gathered: as many as its text holds.
    alone = F.array_sort(F.collect_set(F.when(F.col("kind") == "name", F.struct("canon", "surrogate"))))
    named = joined.where("kind = 'name'").groupBy(*row).agg(alone.alias("_pii_alone")).select(F.col("doc_id").alias("_pii_d"), F.col("_pii_h").alias("_pii_g"), F.col("_pii_alone.canon").alias("_pii_old"), F.col("_pii_alone.surrogate").alias("_pii_to"))
    whole = joined.groupBy(*row, "at", "mention", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "surrogate"))), lambda x: x["surrogate"]).alias("sides"))
    whole = whole.select(*row, "at", rendered(F.col("kind"), F.col("mention"), F.col("sides"), key).alias("new"))
    whole = whole.groupBy(*row).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("_pii_new"))
    new = whole.join(named, F.col("doc_id").eqNullSafe(F.col("_pii_d")) & (F.col("_pii_h") == F.col("_pii_g")), "left").drop("_pii_d", "_pii_g").withColumnRenamed("doc_id", "_pii_id")
    both = docs.join(new, docs["doc_id"].eqNullSafe(new["_pii_id"]) & (F.xxhash64(docs["text"]) == new["_pii_h"]), "left")
    follow = lambda x: F.when(F.col("_pii_old").isNull(), x).otherwise(followed(x, F.col("_pii_old"), F.col("_pii_to")))
    told = F.array_join(F.transform(F.split("text", ENTITY, -1), lambda x, i: F.concat(follow(x), F.coalesce(F.get(F.col("_pii_new"), i), F.lit("")))), "")
    text = F.when(F.col("_pii_new").isNull(), F.col("text")).otherwise(told)
    count = F.when(F.col("_pii_new").isNull(), 0).otherwise(F.size("_pii_new")).cast("bigint")
    return both.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns), count.alias("n_entities"))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), spark)
