"""Surrogates for personal data: keyed, type-consistent replacements with collision checks. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, null_safe

KEY, LONGER = "change-me", {"email": 3, "domain": 3, "number": 8, "ip": 12, "ip6": 3}
#: No entity begins inside a word or number.
EDGE = r"(?<![\p{L}\p{N}_])"
#: A capitalised word of a script that surrogates are made in, and small words inside a name. Fixed values.
CAPITAL = r"[\p{Lu}&&[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]][\p{L}'’-]+"
PARTICLES = r"(?:(?:van|von|de|der|den|del|della|di|da|dos|du|la|le|ten|ter|zu|zur|bin|al) ){0,3}"
#: What is looked for, in this order where several would fit at one place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "ip": r"(?<!\.)(?<![Vv]ersion )(?<![Bb]uild )(?<![Rr]elease )(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[\p{N}])",
    "ip6": r"(?<!:)(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}_:])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}_])",
    "phone": r"(?<!\+)(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4})(?![\p{L}\p{N}])",
    "secret": r"(?:(?i:token|api[_-]?key|secret|passw(?:or)?d|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{12,}|(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,})(?![\p{L}\p{N}_]))",
    "name": r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|Госпожа|Κύριος|Κυρία)\.? " + f"(?:{CAPITAL} )?{PARTICLES}{CAPITAL}",
}
ANY = EDGE + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: A document without any of these holds no entity; most are settled by this alone.
HINT = r"[0-9@=:MHFSГDPΚ](?:(?<=[0-9@=:])|(?<=M)(?:r|s|x|iss|me|onsieur|adame)|(?<=H)err|(?<=F)rau|(?<=S)(?:eñor|r)|(?<=Г)осп|(?<=D)r|(?<=P)rof|(?<=Κ)[υύ]ρ)"
WOMEN = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία)\b"
EITHER = r"^(?:Mx|Dr|Prof|Professor)\b"
#: What is before a secret of a known maker, and addresses that belong to nobody. Fixed values.
MAKER, NOBODY = r"^(?:AKIA|gh[opsu]_)", r"^(?:127\..*|0\.0\.0\.0|255\.255\.255\.255)$"
#: Syllables that names are made of, and what a given name ends in: for a woman, a man, and where a title doesn't tell.
SYLLABLES = {
    "latin": "ba den for gan hol kin lan mer nor pel ros sten tal ver wil zan".split(), "cyrillic": "ба вен дор гал зим кар лин мор нов пет рос сав тар фил хол шин".split(),
    "greek": "βα δεν φορ γαν κιν λαν μερ νορ πελ ρος στεν ταλ βερ θεο ζαν χαρ".split(),
}
ENDINGS = {"latin": ("a", "o", "e"), "cyrillic": ("а", "ий", "о"), "greek": ("α", "ος", "ι")}
LETTERS = {"latin": "bdfghklmnprstvwz", "cyrillic": "бвдгзклмнпрстфхш", "greek": "βγδζθκλμνπρστφχψ"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once; inside a lambda, each mention of an expression would compute it anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(m: Column) -> Column:
    """Which pattern a match of ANY is; null for what is no entity: a long number that fails a card's Luhn check, an address of nobody's."""
    number = F.regexp_replace(m, "[^0-9]", "")
    which = {k: F.lit(k) for k in PATTERNS} | {"card": F.when(F.pmod(luhn_sum(number), F.lit(10)) == 0, "card"), "ip": F.when(~m.rlike(NOBODY), "ip")}
    return reduce(lambda other, k: F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), which[k]).otherwise(other), reversed(list(PATTERNS)[:-1]), F.lit("name"))


def title_and_rest(m: Column) -> tuple[Column, Column]:
    title = F.regexp_extract(m, r"^[\p{L}]+\.? ", 0)
    return title, F.substr(m, F.length(title) + 1)


def canonical(m: Column, kind: Column) -> Column:
    """What an entity is regardless of its writing: separators and letter case don't count, nor do titles and labels."""
    digits = F.regexp_replace(m, "[^0-9+]", "")
    gender = F.when(m.rlike(WOMEN), "f ").when(m.rlike(EITHER), "x ").otherwise("m ")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when((kind == "secret") & m.rlike(MAKER), F.regexp_replace(m, MAKER, ""))
        .when(kind == "secret", F.regexp_extract(m, r"([A-Za-z0-9_+/-]+)$", 1))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "name", F.concat(gender, F.lower(title_and_rest(m)[1])))
        .otherwise(F.lower(m))
    )


def stream(kind: Column, of: Column, attempt: Column, key: str) -> Column:
    """Keyed digest of an entity as 128 hex digits."""
    seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), of)
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|2")), 256))


def draw(h: Column, i: Column | int, size: int) -> Column:
    """A number below size from the i-th of the stream's 64 places, taken in turn."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(61)) * 2 + 1
    return F.pmod(F.conv(F.substr(h, at.cast("int"), F.lit(4)), 16, 10).cast("int"), F.lit(size))


def letter(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), n + 1, F.lit(1))


def masked(s: Column, h: Column, hexadecimal: Column) -> Column:
    """s with each digit and letter replaced by one of its own class; other characters stay."""

    def one(c: Column, i: Column, form: Column) -> Column:
        return (
            F.when(form == "upper", letter("0123456789ABCDEF", draw(h, i, 16)))
            .when(form == "lower", letter("0123456789abcdef", draw(h, i, 16)))
            .when(c.rlike("[0-9]"), letter("0123456789", draw(h, i, 10)))
            .when(c.rlike("[a-z]"), letter("abcdefghijklmnopqrstuvwxyz", draw(h, i, 26)))
            .when(c.rlike("[A-Z]"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", draw(h, i, 26)))
            .otherwise(c)
        )

    form = F.when(hexadecimal & s.rlike("[A-F]"), "upper").when(hexadecimal, "lower").otherwise("mixed")
    return let(form, lambda f: F.array_join(F.transform(F.split(s, ""), lambda c, i: one(c, i, f)), ""))


def refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced in turn by those of `digits`, so any writing of a number gets the same new number."""
    chars = F.split(m, "")
    nth = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), "[^0-9]", ""))
    return let(digits, lambda d: F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(d, nth(i), F.lit(1))).otherwise(c)), ""))


def luhn_sum(number: Column) -> Column:
    """Luhn's sum of all digits, the last one counting once."""

    def of(digits: Column) -> Column:
        n = F.length(digits)

        def step(total: Column, i: Column) -> Column:
            d = F.substr(digits, i.cast("int"), F.lit(1)).cast("int")
            twice = F.pmod(n - i, F.lit(2)) == 1
            return total + F.when(twice & (d > 4), d * 2 - 9).when(twice, d * 2).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)

    return let(number, of)


def new_digits(kind: Column, canon: Column, h: Column, attempt: Column) -> Column:
    """New digits for numbers: a phone's country code, a card's first digit and its Luhn check are kept in kind.

    After many clashes, when all numbers of that length are taken, more digits follow.
    """

    def of(plain: Column, mapped: Column) -> Column:
        country = F.when(canon.startswith("+1"), F.lit("1")).when(canon.startswith("+"), F.substr(plain, F.lit(1), F.lit(2))).otherwise(F.lit(""))
        area = (draw(h, 59, 8) + 2).cast("string")
        phone = F.concat(country, area, F.substr(mapped, F.length(country) + 2))
        body = F.concat(F.substr(plain, F.lit(1), F.lit(1)), F.substr(mapped, F.lit(2), F.length(plain) - 2))
        check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        new = F.when(kind == "phone", phone).when(kind == "card", F.concat(body, check)).otherwise(mapped)
        return F.concat(new, masked(longer(attempt, "number", "0"), h, F.lit(False)))

    return let(F.regexp_replace(canon, "[^0-9]", ""), lambda plain: let(masked(plain, h, F.lit(False)), lambda mapped: of(plain, mapped)))


def longer(attempt: Column, form: str, with_: str) -> Column:
    """What lengthens a surrogate once its format may be full: one more character an attempt, so that rounds end."""
    return F.repeat(F.lit(with_), F.greatest(F.lit(0), attempt - LONGER[form] + 1))


def alike(new: Column, m: Column) -> Column:
    """new in capitals if m is."""
    return F.when((m == F.upper(m)) & (m != F.lower(m)), F.upper(new)).otherwise(new)


def domain_of(canon: Column) -> Column:
    """A mail address's domain without its last label."""
    return F.regexp_extract(canon, "@(.*)\\.[a-z]+$", 1)


def new_domain(domain: Column, attempt: Column, key: str) -> Column:
    return let(stream(F.lit("domain"), domain, attempt, key), lambda h: masked(F.concat(domain, longer(attempt, "domain", "x")), h, F.lit(False)))


def new_part(kind: Column, canon: Column, m: Column, attempt: Column, key: str) -> Column:
    """A given or family name of the same gender, script and case, with hyphens and apostrophes where m has them; each attempt adds a syllable."""
    pick = lambda h, names, i: F.element_at(F.array(*(F.lit(x) for x in names)), draw(h, i, len(names)) + 1)

    def of(h: Column, runs: Column) -> Column:
        def name(script: str) -> Column:
            end = F.when(kind == "family", F.lit("")).when(canon.startswith("f "), F.lit(ENDINGS[script][0])).when(canon.startswith("x "), F.lit(ENDINGS[script][2])).otherwise(F.lit(ENDINGS[script][1]))

            def run(r: Column, i: Column) -> Column:
                many = F.when(F.size(runs) > 1, attempt + 2).otherwise(attempt + 3)
                made = F.array_join(F.transform(F.sequence(F.lit(1), many), lambda j: pick(h, SYLLABLES[script], j + i * 7)), "")
                made = F.when(F.length(r) == 1, letter(LETTERS[script], draw(h, i * 7 + 1, len(LETTERS[script])))).otherwise(F.concat(made, F.when(i == F.size(runs) - 1, end).otherwise("")))
                return F.when(r.rlike("^['’-]$"), r).otherwise(F.initcap(made))

            return F.array_join(F.transform(runs, run), "")

        made = F.when(m.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(m.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))
        return alike(made, m)

    # what a separator ends a name with belongs to no run
    runs = lambda h: let(F.regexp_extract_all(m, F.lit(r"\p{L}+|['’-](?=\p{L})"), 0), lambda r: of(h, r))
    return let(stream(kind, canon, attempt, key), runs)


def new_address(canon: Column, h: Column, attempt: Column) -> Column:
    """An IPv4 address of the same range: private networks stay private ones. A range that may be full gives way to a unique local IPv6 address."""
    octet = lambda i: (draw(h, 3 * i, 254) + 1).cast("string")
    first = draw(h, 0, 223) + 1
    public = F.when(first.isin(10, 127, 169, 172, 192), first + 1).otherwise(first).cast("string")
    head = (
        F.when(canon.startswith("10."), F.concat_ws(".", F.lit("10"), octet(1))).when(canon.startswith("192.168."), F.lit("192.168")).when(canon.startswith("169.254."), F.lit("169.254"))
        .when(canon.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), F.concat(F.lit("172."), (draw(h, 3, 16) + 16).cast("string"))).otherwise(F.concat_ws(".", public, octet(1)))
    )
    return F.when(attempt < LONGER["ip"], F.concat_ws(".", head, octet(2), octet(3))).otherwise(F.concat(F.lit("fd"), grouped(h, 8)))


def grouped(h: Column, groups: int) -> Column:
    """Hex digits of a stream as IPv6 groups, the first of two digits."""
    return F.concat_ws(":", F.substr(h, F.lit(1), F.lit(2)), *(F.substr(h, F.lit(4 * i + 5), F.lit(4)) for i in range(groups - 1)))


def new_groups(canon: Column, h: Column, attempt: Column) -> Column:
    """An IPv6 address with groups as long as before; link-local and unique local ones stay such. Short forms, which are soon full, get all groups."""
    local = F.regexp_extract(canon, "^(fe80|f[cd][0-9a-f]{2}):", 1)
    turned = lambda i: F.concat(F.substr(h, (i * 8 + 1).cast("int")), F.substr(h, F.lit(1), (i * 8).cast("int")))
    group = lambda g, i: F.when((g == "") | (i == 0) & (local != ""), g).otherwise(let(turned(i), lambda t: masked(g, t, F.lit(True))))
    short = F.array_join(F.transform(F.split(canon, ":"), group), ":")
    return F.when(attempt < LONGER["ip6"], short).when(local != "", F.concat(local, F.lit(":0"), grouped(h, 7))).otherwise(F.concat(F.lit("20"), grouped(h, 8)))


def surrogate(m: Column, kind: Column, canon: Column, tries: Callable[[Column | str, Column], Column], key: str) -> Column:
    """The replacement of a match, written as the match is. tries(kind, canon) is the attempt of an entity or a part of one."""
    attempt = tries(kind, canon)

    def of(h: Column) -> Column:
        domain = domain_of(canon)
        local = masked(F.concat(F.regexp_extract(canon, "^([^@]*)@", 1), longer(attempt, "email", "x")), h, F.lit(False))
        mail = F.concat(local, F.lit("@"), let(domain, lambda d: new_domain(d, tries("domain", d), key)), F.regexp_extract(canon, "(\\.[a-z]+)$", 1))
        compact = F.concat(F.substr(canon, F.lit(1), F.lit(2)), masked(F.concat(F.substr(canon, F.lit(3)), longer(attempt, "number", "0")), h, F.lit(False)))
        place = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), " ", ""))
        written = lambda x: F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(x, place(i), F.lit(1)))), "")
        iban = let(compact, lambda x: F.concat(written(x), F.substr(x, F.length(canon) + 1)))
        label = F.substr(m, F.lit(1), F.length(m) - F.length(canon))
        secret = F.concat(label, masked(F.concat(canon, longer(attempt, "number", "0")), h, canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")))
        digits = F.regexp_replace(canon, "[^0-9]", "")
        number = let(new_digits(kind, canon, h, attempt), lambda d: F.concat(refill(m, d), F.substr(d, F.length(digits) + 1)))
        title, rest = title_and_rest(m)
        part = lambda p: new_part(p["kind"], p["canon"], p["m"], tries(p["kind"], p["canon"]), key)
        small = F.regexp_extract(rest, f"(?:^| )({PARTICLES})[^ ]+$", 1)  # these stay as they are
        name = let(F.transform(name_parts(canon, rest), part), lambda x: F.concat(title, F.when(F.size(x) > 1, F.concat(x[0], F.lit(" "))).otherwise(""), small, F.element_at(x, -1)))
        return (
            F.when(kind == "email", let(mail, lambda x: alike(x, m))).when(kind == "ip", new_address(canon, h, attempt)).when(kind == "ip6", alike(new_groups(canon, h, attempt), m)).when(kind == "iban", iban).when(kind == "secret", secret)
            .when(kind == "name", name).otherwise(number)
        )

    return F.when(kind.isNull(), m).otherwise(let(stream(kind, canon, attempt, key), of))


def entity(kind: str | Column, canon: Column, m: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), canon.alias("canon"), m.alias("m"))


def name_parts(canon: Column, rest: Column) -> Column:
    """Given name, if there is one, and family name: each is an entity, so a person with and without given name stays one. Particles are neither."""
    words = F.filter(F.split(rest, " "), lambda w: ~w.rlike(r"^\p{Ll}"))
    family = F.element_at(words, -1)
    last = entity("family", F.lower(family), family)
    given = entity("given", F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.lower(words[0])), words[0])
    return F.when(F.size(words) > 1, F.array(given, last)).otherwise(F.array(last))


def pieces(e: Column) -> Column:
    """What has to be distinct of an entity: itself; a mail address's domain too; of a name its parts."""
    whole = entity(e["kind"], e["canon"], e["m"])
    domain = entity("domain", domain_of(e["canon"]), domain_of(e["canon"]))
    return F.when(e["kind"] == "email", F.array(whole, domain)).when(e["kind"] == "name", name_parts(e["canon"], title_and_rest(e["m"])[1])).otherwise(F.array(whole))


def found(text: Column) -> Column:
    """All entities of a text in order: array<struct<m, kind, canon>>."""
    matches = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(matches, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    return F.transform(kinds, lambda e: F.struct(e["m"].alias("m"), e["kind"].alias("kind"), canonical(e["m"], e["kind"]).alias("canon")))


def clashes(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of entities whose first surrogate won't do: it is another's too, or a real entity's.

    entities: distinct (kind, canon, m, domain_attempt), the last that of a mail address's domain. Of those with one
    surrogate the least keeps it; the others try on until none clash. Each round checks against all surrogates in use.
    Surrogates get longer with the attempts (see LONGER), so there is always room and the rounds end.
    """

    def given(e: DataFrame) -> DataFrame:
        kind, canon, m, attempt = (F.col(c) for c in ("kind", "canon", "m", "attempt"))
        tries = lambda k, _: F.col("domain_attempt") if isinstance(k, str) else attempt
        part = F.when(kind == "domain", new_domain(canon, attempt, key)).when(kind == "given", F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.lower(new_part(kind, canon, m, attempt, key))))
        part = part.when(kind == "family", F.lower(new_part(kind, canon, m, attempt, key)))
        return e.withColumn("said", F.coalesce(part, let(surrogate(m, kind, canon, tries, key), lambda s: canonical(s, kind))))

    now = materialize(given(entities.withColumn("attempt", F.lit(0))), "pii-entities")
    while True:
        owners = now.groupBy("kind", "said").agg(F.min("canon").alias("owner"), F.count("*").alias("n"))
        real = now.select("kind", F.col("canon").alias("said")).distinct()
        shared = owners.filter("n > 1").select("kind", "said", "owner").unionAll(owners.join(real, ["kind", "said"], "left_semi").select("kind", "said", F.lit("").alias("owner")))
        shared = materialize(shared.groupBy("kind", "said").agg(F.min("owner").alias("owner")), "pii-shared")
        bad = now.join(shared, ["kind", "said"]).filter("canon <> owner").select("kind", "canon", "m", "domain_attempt", (F.col("attempt") + 1).alias("attempt"))
        bad = materialize(given(bad), "pii-bad")
        discard(shared)
        if bad.isEmpty():
            discard(bad)
            out = materialize(now.filter("attempt > 0").select("kind", "canon", "attempt"), "pii-again")
            discard(now)
            return out
        after = materialize(now.join(bad.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(bad), "pii-entities")
        discard(now, bad)
        now = after


def settle(entities: DataFrame, key: str) -> DataFrame:
    """clashes() of all entities, those of domains first, as mail addresses hold them."""
    entities = materialize(entities, "pii-all")
    domains = clashes(entities.filter("kind = 'domain'").withColumn("domain_attempt", F.lit(0)), key)
    held = domains.select(F.col("canon").alias("of"), F.col("attempt").alias("domain_attempt"))
    rest = entities.filter("kind <> 'domain'").withColumn("domain", F.when(F.col("kind") == "email", domain_of(F.col("canon"))))
    rest = rest.join(held, F.col("domain") == F.col("of"), "left").select("kind", "canon", "m", F.coalesce("domain_attempt", F.lit(0)).alias("domain_attempt"))
    others = clashes(rest, key)
    out = materialize(domains.unionByName(others), "pii-tries")
    discard(entities, domains, others)
    return out


def replace(docs: DataFrame, text: str = "text", key: str = "doc_id", secret_key: str = KEY) -> DataFrame:
    """key, text with surrogates, and n_entities of every row.

    Found are mail, IPv4 and IPv6 addresses, phone, card (by Luhn's check) and account numbers, social security numbers, labelled
    secrets and keys of known makers, and names after a title; what such a name consists of is replaced wherever else it stands in that document, as it is written or
    in capitals, so a person stays one. A surrogate depends on secret_key and on what the entity is, so it is the same wherever and
    however the entity is written; it keeps separators, case and length class, a phone's country, a card's first digit
    and Luhn check, a mail domain's identity, an address's private range, and a name's gender, script, particles and hyphens. Given and family names have surrogates of their
    own, so "Mr. Smith" and "Mr. John Smith" keep one family name. Surrogates are checked over all entities of
    the corpus: none is shared by two and none is a real entity. First surrogates need no join; only the few that clash
    do, by entity, so common entities cost nothing. Null and empty texts stay as they are; repeated rows stay; texts may be of
    any length. Other columns are not read. An empty table gives no rows.
    """
    rows = null_safe(docs, key, text).toDF("id", "body")
    listed = rows.select(F.explode(F.flatten(F.transform(F.filter(found(F.col("body")), lambda e: e["kind"].isNotNull()), pieces))).alias("e"))
    again = settle(listed.select("e.kind", "e.canon", "e.m").groupBy("kind", "canon").agg(F.min("m").alias("m")), secret_key)
    seen = rows.withColumn("e", found(F.col("body")))
    if again.isEmpty():
        attempt = lambda kind, canon: F.lit(0)
    else:
        named = seen.withColumn("row", F.struct(F.xxhash64("body").alias("x"), F.xxhash64(F.lit(7), "body").alias("y")))
        uses = named.select("row", F.explode(F.flatten(F.transform(F.filter("e", lambda e: e["kind"].isNotNull()), pieces))).alias("u"))
        uses = uses.select("row", "u.kind", "u.canon").distinct().join(again, ["kind", "canon"])
        tries = uses.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("tries"))
        seen = named.join(materialize(tries, "pii-tries"), "row", "left").drop("row")
        attempt = lambda kind, canon: F.coalesce(F.element_at("tries", F.concat_ws("|", F.lit(kind) if isinstance(kind, str) else kind, canon)), F.lit(0))
    new = F.transform("e", lambda e: surrogate(e["m"], e["kind"], e["canon"], attempt, secret_key))
    said = F.array_distinct(F.flatten(F.transform(F.filter("e", lambda e: e["kind"] == "name"), lambda e: name_parts(e["canon"], title_and_rest(e["m"])[1]))))
    alone = F.transform(said, lambda p: F.struct(p["m"].alias("old"), new_part(p["kind"], p["canon"], p["m"], attempt(p["kind"], p["canon"]), secret_key).alias("new")))
    seen = seen.withColumn("alone", alone).withColumn("between", F.split(F.col("body"), ANY, -1))
    whole = lambda old: F.concat(F.lit(EDGE), old, F.lit(r"(?![\p{L}\p{N}_])"))
    named_too = lambda t: F.aggregate("alone", t, lambda acc, p: F.regexp_replace(F.regexp_replace(acc, whole(p["old"]), p["new"]), whole(F.upper(p["old"])), F.upper(p["new"])))
    between = F.when(F.size("alone") > 0, F.transform("between", named_too)).otherwise(F.col("between"))
    count = F.size(F.filter("e", lambda e: e["kind"].isNotNull())).cast("long")
    joined = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return seen.select(F.col("id").alias(key), F.when(count > 0, joined).otherwise(F.col("body")).alias(text), count.alias("n_entities"))
