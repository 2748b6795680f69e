"""Personal data replaced by keyed surrogates of the same kind.

Entities are found by pattern, reduced to a canonical form (so that one
number written in two ways is one entity), and given a surrogate drawn from a
keyed hash.  A collision check gives any two entities different surrogates and
keeps surrogates apart from the entities of the corpus.  The surrogate is then
written in the form of each mention: same separators, same case, same script,
a name of the same gender.  Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofield.llm.common import shared_table

ROUNDS = 40

# Titles by gender, given names by gender and script, alphabets and syllables by script.
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]
NEUTRAL = ["Mx", "Dr", "Prof"]
GIVEN = {
    "ml": "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Simon Tom Victor",
    "fl": "Anna Bella Clara Diana Emma Flora Helen Ida Julia Karin Laura Maria Nora Olga Petra Rosa Sara Vera",
    "nl": "Alex Andrea Charlie Dominique Eli Jules Kim Lou Maxime Noa Robin Sascha",
    "mc": "Антон Борис Виктор Иван Кирилл Лев Максим Олег Павел Юрий",
    "fc": "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Юлия",
    "nc": "Саша Женя Валя",
    "mg": "Ανδρέας Γιάννης Δημήτρης Κώστας Νίκος Πέτρος",
    "fg": "Άννα Ελένη Κατερίνα Μαρία Σοφία Ειρήνη",
    "ng": "Άρης Θάλεια",
}
ALPHABET = {"l": "abcdefghijklmnopqrstuvwxyz", "c": "абвгдежзиклмнопрстуфхцчш", "g": "αβγδεζηθικλμνξοπρστυφχψω"}
SYLLABLES = {
    "l": "ba be bo da de do fa fe ga go ha he ja ka ke ko la le li lo ma me mi mo na ne no pa pe po ra re ri ro sa se ta te to va ve vo wa za",
    "c": "ба бо ва ве да до за ка ко ла ле ли ма ме ми мо на не но па по ра ре ро са се та то ха",
    "g": "βα βο δα δε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε τα τε το",
}

_EDGE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
_WORD = r"\p{Lu}[\p{L}'’\-]+"
_TITLE = "(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.?"
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+"
# The rest start where no letter or digit comes before, see ANY.
NAME = _TITLE + f" {_WORD}(?: {_WORD})?"
IP = r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)"
HEX = r"(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,128}" + _END
SECRET = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z\-_]{20,}|xox[abpr]-[0-9A-Za-z\-]{10,})" + _END
IBAN = r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _END
SSN = r"\d{3}-\d{2}-\d{4}" + _END
CARD = r"\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}" + _END
PHONE = (
    r"(?<!\+)(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}"
    r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})" + _END
)
ANY = EMAIL + "|" + _EDGE + "(?:" + "|".join([NAME, IP, HEX, SECRET, IBAN, SSN, PHONE, CARD]) + ")"
MAYBE = r"[0-9@]|AKIA|gh[pousr]_|sk-|xox[abpr]-|" + _TITLE + r" \p{Lu}"


def _sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lit(raw: str) -> str:
    return f"array(named_struct('kind', '', 'canon', '', 'raw', {raw}))"


def _one(kind: str, canon: str, raw: str = "m") -> str:
    return f"array(named_struct('kind', {kind}, 'canon', {canon}, 'raw', {raw}))"


def _script(word: str) -> str:
    return (f"CASE WHEN {word} RLIKE '^\\\\p{{IsCyrillic}}' THEN 'c' WHEN {word} RLIKE '^\\\\p{{IsGreek}}' THEN 'g'"
            " ELSE 'l' END")


def _segments() -> str:
    """SQL for the text as an array of segments (kind, canon, raw) whose ``raw`` parts join to the text.

    ``kind`` is empty for literal segments.
    """
    title, words = f"regexp_extract(m, {_sql('^' + _TITLE + ' ')}, 0)", f"regexp_extract(m, {_sql('^' + _TITLE + ' (.+)$')}, 1)"
    bare = f"rtrim('. ', {title})"
    male, female = (", ".join(_sql(t) for t in names) for names in (MALE, FEMALE))
    gender = f"CASE WHEN {bare} IN ({male}) THEN 'm' WHEN {bare} IN ({female}) THEN 'f' ELSE 'n' END"
    given, last = f"substring_index({words}, ' ', 1)", f"substring_index({words}, ' ', -1)"
    name = f"""concat({_lit(title)},
        CASE WHEN {words} LIKE '% %' THEN concat(
            {_one(f"concat('given', {gender}, {_script(given)})", f"lower({given})", given)}, {_lit("' '")})
        ELSE array() END,
        {_one(f"concat('last', {_script(last)})", f"lower({last})", last)})"""
    digits = "regexp_replace(m, '[^0-9]', '')"
    entity = f"""CASE
        WHEN m LIKE '%@%' THEN {_one("'email'", "lower(m)")}
        WHEN m RLIKE {_sql('^' + NAME + '$')} THEN {name}
        WHEN m RLIKE {_sql('^' + IP + '$')} THEN {_one("'ip'", "m")}
        WHEN m RLIKE {_sql('^' + HEX + '$')} THEN {_one("'hex'", "lower(m)")}
        WHEN m RLIKE {_sql('^' + SECRET + '$')} THEN {_one("'secret'", "m")}
        WHEN m RLIKE '^[A-Z]' THEN {_one("'iban'", "replace(m, ' ', '')")}
        WHEN m RLIKE {_sql('^' + SSN + '$')} THEN {_one("'ssn'", digits)}
        WHEN m RLIKE {_sql('^' + CARD + '$')} THEN {_one("'card'", digits)}
        ELSE {_one("'phone'", digits)} END"""
    return f"""flatten(zip_with(split(text, {_sql(ANY)}, -1), regexp_extract_all(text, {_sql(ANY)}, 0),
        (gap, m) -> CASE WHEN m IS NULL THEN {_lit("coalesce(gap, '')")} ELSE concat({_lit("gap")}, {entity}) END))"""


def _with_segments(docs: DataFrame) -> DataFrame:
    return docs.withColumn("segments", F.expr(_segments()))


def _draw(place: str, options: int | str) -> str:
    """SQL for a keyed number below ``options``, one for each place of an entity's surrogate."""
    return (f"(CAST(conv(substr(sha2(concat_ws('|', secret, kind, canon, attempt, {place}), 256), 1, 12), 16, 10)"
            f" AS BIGINT) % {options})")


def _pick(words: str, place: str) -> str:
    items = words.split()
    return f"element_at(split({_sql(' '.join(items))}, ' '), CAST(1 + {_draw(place, len(items))} AS INT))"


def _by_class(value: str, low: str = "") -> str:
    """SQL that redraws every digit and letter of ``value`` within its class, script and case."""
    def letter(alphabet: str) -> str:
        return f"substr({_sql(alphabet)}, CAST(1 + {_draw('i', len(alphabet))} AS INT), 1)"

    latin = low or ALPHABET["l"]
    return f"""array_join(transform(split({value}, ''), (c, i) -> CASE
        WHEN c RLIKE '[0-9]' THEN CAST({_draw('i', 10)} AS STRING)
        WHEN c RLIKE '\\\\p{{IsCyrillic}}' THEN {letter(ALPHABET['c'])}
        WHEN c RLIKE '\\\\p{{IsGreek}}' THEN {letter(ALPHABET['g'])}
        WHEN c RLIKE '\\\\p{{Lu}}' THEN upper({letter(latin)})
        WHEN c RLIKE '\\\\p{{L}}' THEN {letter(latin)}
        ELSE c END), '')"""


def _candidate() -> str:
    """SQL for the surrogate of (kind, canon) at an attempt; later attempts have more room."""
    given = " ".join(f"WHEN kind = 'given{k}' THEN {_pick(v, '1')}" for k, v in GIVEN.items())
    more = " ".join(
        f"WHEN substr(kind, -1) = '{k}' THEN array_join(transform(sequence(1, n), i -> {_pick(v, '100 + i')}), '')"
        for k, v in SYLLABLES.items()
    )
    def syllables(n: str) -> str:
        return f"CASE WHEN {n} < 1 THEN '' {more} END".replace("sequence(1, n)", f"sequence(1, greatest(1, {n}))")

    return f"""CASE
        WHEN kind = 'email' THEN concat({_by_class("substring_index(canon, '@', 1)")},
            CASE WHEN attempt > 0 THEN CAST({_draw("'more'", 1000000)} AS STRING) ELSE '' END,
            '@mail', {_draw("'host'", 1000)}, '.example.', {_pick("com org net", "'top'")})
        WHEN kind = 'ip' THEN concat_ws('.', 1 + {_draw('1', 223)}, {_draw('2', 256)}, {_draw('3', 256)}, 1 + {_draw('4', 254)})
        WHEN kind = 'hex' THEN {_by_class('canon', 'abcdef')}
        WHEN kind = 'secret' THEN concat(substr(canon, 1, 4), {_by_class('substr(canon, 5)')})
        WHEN kind = 'iban' THEN concat(substr(canon, 1, 2), {_by_class('substr(canon, 3)')})
        WHEN kind = 'phone' AND length(canon) > 10 THEN concat(substr(canon, 1, 1), {_by_class('substr(canon, 2)')})
        WHEN kind IN ('phone', 'ssn', 'card') THEN {_by_class('canon')}
        WHEN kind LIKE 'given%' THEN concat(lower(CASE {given} END), {syllables('attempt')})
        ELSE {syllables('attempt + 3')} END"""


def _written() -> str:
    """SQL for a surrogate in the form of the mention ``raw``."""
    fill = """array_join(transform(split(raw, ''), (c, i) -> CASE WHEN c RLIKE '[0-9A-Z]' THEN
        substr(surrogate, 1 + length(regexp_replace(substr(raw, 1, i), '[^0-9A-Z]', '')), 1) ELSE c END), '')"""
    return f"""CASE WHEN kind IN ('phone', 'ssn', 'card', 'iban') THEN {fill}
        WHEN kind IN ('ip', 'secret') THEN surrogate
        WHEN raw = upper(raw) AND raw <> lower(raw) THEN upper(surrogate)
        WHEN kind LIKE 'given%' OR kind LIKE 'last%' THEN initcap(surrogate)
        ELSE surrogate END"""


def assign(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon): no two entities of a kind share a surrogate,
    and no surrogate is an entity.

    Entities whose candidate is taken draw again in the next round, the
    smallest entity of those that drew the same candidate keeps it.  Most are
    settled in the first round.  A kind with more entities than it has possible
    values ends in an error after ROUNDS rounds.
    """
    real = shared_table(entities.select("kind", "canon").distinct(), "entities")
    group = F.substring("kind", 1, 4)
    taken = real.select(group.alias("group"), F.col("canon").alias("surrogate"))
    done, open_ = None, real
    for attempt in range(ROUNDS):
        drawn = open_.withColumns({"secret": F.lit(secret), "attempt": F.lit(attempt)}).select(
            "kind", "canon", group.alias("group"), F.expr(_candidate()).alias("surrogate")
        )
        free = drawn.join(taken, ["group", "surrogate"], "left_anti")
        first = free.groupBy("group", "surrogate").agg(F.min(F.struct("kind", "canon")).alias("e"))
        won = shared_table(first.select("e.kind", "e.canon", "group", "surrogate"), "surrogates")
        done = won if done is None else done.union(won)
        taken = taken.union(won.select("group", "surrogate"))
        open_ = shared_table(open_.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "waiting")
        if open_.isEmpty():
            return done.select("kind", "canon", "surrogate")
    raise ValueError("more entities of a kind than it has possible surrogates")


def replace_entities(docs: DataFrame, secret: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced; optionally a count column ``found``.

    All columns and rows are kept; a null text stays null, a text without
    entities stays as it is.  One entity has one surrogate in all documents.
    Only texts that may hold entities are shuffled, keyed by their SHA-256, so
    that copies of a text share one row on the side that is looked up.
    """
    names = [c for c in docs.columns if c != found]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("text"))
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    hits = rows.filter(maybe).withColumn("key", F.sha2("text", 256))
    # An outer explode, because an inner one would have the segments computed twice.
    mentions = shared_table(
        _with_segments(hits.select("key", "text")).select("key", F.posexplode_outer("segments").alias("pos", "s"))
        .filter(F.col("s.kind") != "").select("key", "pos", "s.kind", "s.canon", "s.raw").distinct(),
        "mentions",
    )
    surrogates = assign(mentions, secret)
    written = mentions.join(surrogates, ["kind", "canon"]).select("key", "pos", F.expr(_written()).alias("out"))
    patches = written.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("pos", "out"))).alias("patch"))
    patched = f"array_join(transform({_segments()}, (s, i) -> coalesce(patch[i], s.raw)), '')"
    mended = hits.join(patches, "key", "left").select(
        "row", F.expr(f"CASE WHEN patch IS NULL THEN text ELSE {patched} END").alias("text"),
        F.coalesce(F.size("patch"), F.lit(0)).cast("long").alias("n"),
    )
    whole = rows.filter(~maybe).select("row", "text", F.lit(0).cast("long").alias("n")).unionByName(mended)
    columns = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in names]
    return whole.select(*columns, *([F.col("n").alias(found)] if found else []))
