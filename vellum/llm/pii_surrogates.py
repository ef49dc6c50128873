"""Surrogates for personal data, in Spark SQL expressions only.

Entities are e-mail addresses, telephone numbers, IPv4 addresses, payment-card numbers (with a valid
check digit) and names: after a title, and later in the same document the found names without one.
Every entity has a canonical form (lower case; digits only; a telephone number without
a separated country code and a first zero, at most its last ten digits) and one keyed surrogate of the same type: digits for
digits with a valid check digit for cards, octets for addresses, a name in the script of the original
and of the gender that its titles in the whole table name (none where they name none or both). All
mentions of one entity, in any spelling, layout or with any title, get that one surrogate, each in
its own layout and case, so coreference is kept.

The documents are searched once and written with their spans. The distinct entities (aggregated before
any shuffle) get surrogates from a keyed SHA-512; a check then looks for surrogates shared by two
entities or equal to a canonical form that really occurs, and gives those a new attempt until none is
left, so distinct entities stay distinct. Texts with entities are put together again from the
mentions; the others are passed on untouched.

Limits: ten digits in a row without a plus sign or separators are not taken for a telephone number; a
name must stand after a title somewhere in its document; more than ``ROUNDS`` attempts are an error.

Defined cases: null and empty texts have no entities and stay as they are; of overlapping mentions the
one that starts first (then the longer) is replaced; repeated rows are changed alike; an empty table
gives no rows; other columns pass through; the key has no default and is not written anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.secret_scan import CLOSE, OPEN, OTHER, Rule, _found
from vellum.session import scratch_path

ROUNDS = 40

# Titles by language and gender, syllables by script.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Don", "Г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Doña", "Г-жа")
NEUTRAL = ("Dr", "Prof")
LATIN = ("ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "to", "va", "ze", "lu", "ra")
CYRILLIC = ("ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "си", "то", "ва", "зе", "лу", "ра")
GREEK = ("βα", "δε", "φι", "γο", "κα", "λε", "μι", "νο", "πα", "ρε", "σι", "το", "βε", "ζε", "λυ", "ρα")
HAN = ("王", "李", "林", "高", "山", "田", "中", "木", "村", "川", "石", "原", "文", "明", "春", "和")
ARABIC = ("با", "دي", "في", "جو", "كا", "لي", "مي", "نو", "را", "سي", "تو", "وا", "زي", "لو", "ها", "شا")
TABLES = {"latin": LATIN, "cyrillic": CYRILLIC, "greek": GREEK, "han": HAN, "arabic": ARABIC}

_TITLE = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
# A word of a name: a capital and letters, parts joined by an apostrophe or a hyphen; or a caseless script.
_WORD = r"(?:\p{Lu}(?:['’]\p{Lu})?\p{L}{1,30}(?:['’-]\p{L}{1,30}){0,3}|\p{Lo}[\p{Lo}\p{M}]{0,30})"
# What a mention looks like. Lookbehinds keep a search from starting inside a run.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![A-Za-z0-9-])",
    "phone": (r"(?<![\w+.])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{4}"
              r"|\+\d{8,15}|\+\d{1,3}(?:[ .-]\d{2,4}){3,5}|\+\d{1,3}[ .-]\d(?:[ .-]\d{2}){4}|0\d(?:[ .-]\d{2}){4})(?![\w-]|\.\d)"),
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_WORD}(?: {_WORD})?(?!\p{{L}})",
}
KINDS = tuple(PATTERNS)


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check over a string of digits."""
    n = F.char_length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _gate(text: Column, kind: str) -> Column:
    """A cheap necessary condition of any mention of the kind."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "name":
        return text.rlike(rf"(?:{_TITLE})\.? [\p{{Lu}}\p{{Lo}}]")
    return text.rlike(r"\d[^\p{L}]{0,3}\d")


def _pieces(text: Column, pattern: Column) -> Column:
    return F.split(F.regexp_replace(text, pattern, F.lit(OPEN + "$0" + CLOSE)), OPEN)


def _mentions(pieces: Column, kind: str) -> Column:
    """array<struct<start, end, kind, hit>> of one kind."""
    spans = _found(pieces, Rule(kind, ""), "")
    return F.filter(spans, lambda s: _luhn_sum(_digits(s["hit"])) % 10 == 0) if kind == "card" else spans


def _untitled(hit: Column) -> Column:
    """The words of a name without its title."""
    return F.split(F.regexp_replace(hit, rf"^(?:{_TITLE})\.? ", ""), " ")


def _any_of(words: Column) -> Column:
    """An expression that finds the words where they stand alone (none of nothing)."""
    listed = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|")
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), listed, F.lit(r")(?![\p{L}\p{N}])"))).otherwise(r"(?!)")


def with_mentions(docs: DataFrame) -> DataFrame:
    """All columns and ``__mentions``: mentions of all kinds that do not overlap, by start."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    rows = docs.withColumn("__searched", text)
    searched = F.col("__searched")
    rows = rows.withColumns({f"__pieces_{k}": _pieces(F.when(_gate(searched, k), searched).otherwise(""), F.lit(PATTERNS[k]))
                             for k in KINDS})
    rows = rows.withColumns({f"__of_{k}": _mentions(F.col(f"__pieces_{k}"), k) for k in KINDS})
    # the names of the document, looked for again without their titles
    words = F.transform("__of_name", lambda s: _untitled(s["hit"]))
    rows = rows.withColumn("__last", F.array_distinct(F.transform(words, lambda w: F.element_at(w, -1))))
    rows = rows.withColumn("__first", F.array_except(F.transform(F.filter(words, lambda w: F.size(w) > 1), lambda w: w[0]), "__last"))
    again = F.when(F.size("__of_name") > 0, searched).otherwise("")
    rows = rows.withColumns({f"__pieces_{k}": _pieces(again, _any_of(F.col(f"__{k}"))) for k in ("last", "first")})
    some = [F.col(f"__of_{k}") for k in KINDS] + [_mentions(F.col(f"__pieces_{k}"), k) for k in ("last", "first")]
    ranked = F.sort_array(F.transform(F.concat(*some), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["hit"].alias("hit"))))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    rows = rows.select(*kept, ranked.alias("__all"))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint,kind:string,hit:string>>").alias("kept"))

    def step(acc, s):
        item = F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"))
        fits = s["start"] >= acc["at"]
        return F.struct(F.when(fits, -s["back"]).otherwise(acc["at"]).alias("at"),
                        F.when(fits, F.concat(acc["kept"], F.array(item))).otherwise(acc["kept"]).alias("kept"))

    return rows.withColumn("__mentions", F.aggregate("__all", begin, step)["kept"]).drop("__all")


def _title_of(hit: Column) -> Column:
    return F.regexp_extract(hit, rf"^({_TITLE})(\.? )", 1)


def _gender(hit: Column) -> Column:
    title = _title_of(hit)
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def _script(name: Column) -> Column:
    return (F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek")
            .when(name.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"), "han")
            .when(name.rlike(r"\p{IsArabic}"), "arabic").otherwise("latin"))


def entities_of(kind: Column, hit: Column) -> Column:
    """array<struct<kind, canon, gender>>: one entity for most kinds; for names the first and the last
    name, so that "Mr A B" and "Mr B" share the last name. The gender is the title's (null: none)."""
    words = _untitled(hit)
    none = F.lit(None).cast("string")

    def one(k, c, gender=none):
        return F.struct(k.alias("kind"), c.alias("canon"), gender.alias("gender"))

    end = words[F.size(words) - 1]
    last = one(F.concat(F.lit("last_"), _script(end)), F.lower(end))
    first = one(F.concat(F.lit("first_"), _script(words[0])), F.lower(words[0]), F.nullif(_gender(hit), F.lit("n")))
    names = F.when(F.size(words) > 1, F.array(first, last)).otherwise(F.array(last))
    # a telephone number without its country code and its first zero
    local = F.regexp_replace(_digits(F.regexp_replace(hit, r"^\+\d{1,3}[ .-]", "")), "^0", "")
    local = F.when(F.char_length(local) > 10, F.substring(local, -10, 10)).otherwise(local)
    number = F.when(kind == "phone", local).otherwise(_digits(hit))
    canon = F.when(kind == "email", F.lower(hit)).when(kind == "ip", hit).otherwise(number)
    return (F.when(kind.isin("name", "last"), names).when(kind == "first", F.array(first))
            .otherwise(F.array(one(kind, canon))))


def entities(mentioned: DataFrame) -> DataFrame:
    """kind, canon: the distinct entities; a first name's kind has its gender over all its titles
    (``first_m_latin``; ``n`` where they name none or both)."""
    each = mentioned.groupBy("kind", "canon").agg(F.min("gender").alias("low"), F.max("gender").alias("high"))
    gender = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("n")
    kind = F.when(F.col("kind").startswith("first_"), F.concat(F.lit("first_"), gender, F.substring("kind", 6, 99)))
    return each.select(F.coalesce(kind, "kind").alias("kind"), "canon")


def _byte(digest: Column, i) -> Column:
    """Byte ``i`` (0 to 63) of a SHA-512 in hexadecimal."""
    return F.conv(F.substring(digest, (2 * (i % 64) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _syllables(digest: Column, table: tuple[str, ...], at: int, n: int) -> Column:
    names = F.array(*map(F.lit, table))
    return F.concat(*[names[_byte(digest, F.lit(at + j)) % len(table)] for j in range(n)])


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of an entity at an attempt."""
    digest = F.sha2(F.concat_ws("\x00", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)
    n = F.char_length(canon)
    digit = lambda i: F.when(i == 0, 1 + _byte(digest, i) % 9).otherwise(_byte(digest, i) % 10).cast("string")
    digits = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), digit), "")
    body = F.concat(F.substring(digits, F.lit(1), n - 1), F.lit("0"))
    card = F.concat(F.substring(digits, F.lit(1), n - 1), ((10 - _luhn_sum(body) % 10) % 10).cast("string"))
    ip = F.concat_ws(".", *[(1 + _byte(digest, F.lit(j)) * 253 / 255).cast("int").cast("string") for j in range(4)])
    email = F.concat(_syllables(digest, LATIN, 0, 3), F.lit("."), _syllables(digest, LATIN, 3, 3),
                     (_byte(digest, F.lit(6)) * 256 + _byte(digest, F.lit(7))).cast("string"), F.lit("@"),
                     _syllables(digest, LATIN, 8, 4), F.lit(".example"))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", digits)
    for script, table in TABLES.items():
        ending = F.when(kind.startswith("first_f"), table[0][-1]).when(kind.startswith("first_m"), table[3][-1]).otherwise("")
        made = F.concat(_syllables(digest, table, 0, 4), ending)
        out = out.when(kind.endswith(script), made)
    return out


def assign(entities: DataFrame, work: str, key: str) -> DataFrame:
    """kind, canon, made: distinct surrogates, none equal to an entity of its kind."""
    spark = entities.sparkSession
    kind, canon = F.col("kind"), F.col("canon")
    entities.select("kind", "canon", F.lit(0).alias("attempt")).write.parquet(f"{work}/attempt-0")
    for step in range(ROUNDS):
        now = spark.read.parquet(f"{work}/attempt-{step}").withColumn("made", surrogate(kind, canon, F.col("attempt"), key))
        # of the entities that share a surrogate the first keeps it, unless it is a real one
        first = now.groupBy("kind", "made").agg(F.min("canon").alias("keeper"), F.count("*").alias("n"))
        real = now.select("kind", F.col("canon").alias("made"), F.lit(True).alias("real"))
        clash = first.join(real, ["kind", "made"], "left").where("n > 1 OR real").select("kind", "made", "keeper", "real")
        if clash.limit(1).count() == 0:
            return now.select("kind", "canon", "made")
        again = now.join(clash, ["kind", "made"], "left")
        redo = F.col("keeper").isNotNull() & (F.coalesce("real", F.lit(False)) | (F.col("keeper") != canon))
        again.select("kind", "canon", (F.col("attempt") + redo.cast("int")).alias("attempt")).write.parquet(f"{work}/attempt-{step + 1}")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} attempts")


def _cased(like: Column, made: Column) -> Column:
    """``made`` in capitals, with a leading capital, or as it is, like ``like``."""
    return (F.when((F.upper(like) == like) & (F.lower(like) != like) & (F.char_length(like) > 1), F.upper(made))
            .when(F.substring(like, 1, 1) != F.lower(F.substring(like, 1, 1)), F.initcap(made)).otherwise(made))


def _laid_out(kind: Column, hit: Column, made: Column) -> Column:
    """The surrogates of a mention's entities in the mention's layout."""
    size = F.char_length(hit)
    spare = F.char_length(_digits(hit)) - F.char_length(made[0])

    def put(i):
        c = F.substring(hit, i, F.lit(1))
        # digits before the entity's own (a country code) stay
        nth = F.char_length(_digits(F.substring(hit, F.lit(1), i))) - spare
        return F.when(c.rlike("[0-9]") & (nth > 0), F.substring(made[0], nth, F.lit(1))).otherwise(c)

    digits = F.array_join(F.transform(F.sequence(F.lit(1), size), put), "")
    lead = F.regexp_extract(hit, rf"^((?:{_TITLE})\.? )", 1)
    words = F.split(F.substring(hit, F.char_length(lead) + 1, size), " ")
    name = F.concat(lead, F.array_join(F.zip_with(words, made, _cased), " "))
    email = F.when((F.upper(hit) == hit) & (F.lower(hit) != hit), F.upper(made[0])).otherwise(made[0])
    return F.when(kind == "email", email).when(kind == "ip", made[0]).when(
        kind.isin("name", "last", "first"), name).otherwise(digits)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the mentions in ``text`` replaced, and ``__mentions`` as found before."""
    spark, work = docs.sparkSession, scratch_path(docs.sparkSession, "surrogates")
    found = with_mentions(docs).withColumn("__row", F.monotonically_increasing_id())
    found.write.parquet(f"{work}/found")
    rows = spark.read.parquet(f"{work}/found")
    each = (rows.where(F.size("__mentions") > 0).select("__row", F.posexplode("__mentions").alias("nth", "m"))
            .select("__row", "nth", F.col("m.kind").alias("mk"), F.col("m.hit").alias("hit"),
                    F.posexplode(entities_of(F.col("m.kind"), F.col("m.hit"))).alias("piece", "e"))
            .select("__row", "nth", "mk", "hit", "piece", "e.kind", "e.canon", "e.gender"))
    assign(entities(each), work, key).write.parquet(f"{work}/surrogates")
    table = spark.read.parquet(f"{work}/surrogates").withColumn("kind", F.regexp_replace("kind", "^first_[mfn]_", "first_"))
    made = each.join(table, ["kind", "canon"])
    mention = made.groupBy("__row", "nth").agg(
        F.first("mk").alias("mk"), F.first("hit").alias("hit"), F.array_sort(F.collect_list(F.struct("piece", "made"))).alias("p"))
    laid = mention.select("__row", "nth", _laid_out(F.col("mk"), F.col("hit"), F.transform("p", lambda x: x["made"])).alias("new"))
    lists = laid.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("nth", "new"))).alias("__new"))
    changed = rows.where(F.size("__mentions") > 0).join(lists, "__row")
    text = F.col("text")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        m = x["__mentions"]
        between = F.substring(text, (acc["at"] + 1).cast("int"), (m["start"] - acc["at"]).cast("int"))
        return F.struct(m["end"].alias("at"), F.concat(acc["out"], between, x["__new"]["new"]).alias("out"))

    done = F.aggregate(F.arrays_zip("__mentions", "__new"), begin, step)
    new = F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text)))
    cols = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return (changed.select(*cols, new.alias("text"), "__mentions")
            .unionByName(rows.where(F.size("__mentions") == 0).select(*cols, "text", "__mentions")))


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with surrogates), n_entities and the number of mentions of each kind."""
    out = replace(docs.select("doc_id", "text"), key)


    def count(kind: str) -> Column:
        kinds = ("name", "last", "first") if kind == "name" else (kind,)
        return F.size(F.filter("__mentions", lambda m: m["kind"].isin(*kinds))).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", "text", F.size("__mentions").cast("long").alias("n_entities"),
                      *map(count, KINDS))
