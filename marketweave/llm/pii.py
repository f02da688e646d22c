"""Personal data in texts: patterns propose, checksums confirm, context scores.

For each kind a regular expression finds candidate spans; card numbers must
pass Luhn, account numbers the mod-97 check, addresses and phone numbers their
ranges. A validated candidate has its kind's score, raised when a context word
stands near; spans under the threshold are dropped, which only touches kinds
whose pattern alone proves little. All of it is SQL functions: the pieces
between matches (``split`` by the same pattern) give the places.

The patterns below can only start where a run of their characters starts (or
where the last match ended), and repeat possessively: that changes no match,
but a long run costs linear time. Account numbers are the exception: words
after one look like more of it, so the pattern only finds where one may start
and the check picks its end (``_accounts``), of at most 31.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """ISO 7064 remainder of an account number (letters count 10 .. 35)."""
    flat = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _always(m: Column) -> Column:
    return F.lit(True)


def _mixed(m: Column) -> Column:
    """As varied as a random string: ten or more different characters, digits and letters among them."""
    return (F.size(F.array_distinct(F.split(m, ""))) >= 10) & m.rlike("[0-9]") & m.rlike("[A-Za-z]")


_SPANS = "array<struct<start:int,end:int,match:string>>"


#: The longest run of account characters (15 to 34 and single blanks) that ends with a word.
ACCOUNT = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
#: Length of the account numbers by country.
LENGTHS = ("AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 "
           "FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
           "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 "
           "SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30")


def _accounts(text: Column, starts: Column) -> Column:
    """Account numbers at ``starts`` (spans of their first four characters).

    An account number may end at any word edge; of the ends that pass mod-97
    the one of the country's length is taken, else the longest. A start
    inside an account number found before is none.
    """
    flat = lambda m: F.length(F.replace(m, F.lit(" "), F.lit("")))

    def cuts(run: Column) -> Column:
        parts = F.split(run, " ")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), " "))

    def ranked(m: Column) -> Column:
        usual = F.contains(F.lit(LENGTHS), F.concat(F.substring(m, 1, 2), flat(m).cast("string")))
        return F.struct(usual.alias("usual"), F.length(m).alias("n"), m.alias("match"))

    def best(s: Column) -> Column:
        run = F.regexp_extract(F.substring(text, s["start"] + 1, F.lit(65)), ACCOUNT, 0)
        valid = F.filter(cuts(run), lambda m: flat(m).between(15, 34) & (_mod97(m) == 1))
        return F.struct(s["start"].alias("start"), F.array_max(F.transform(valid, ranked))["match"].alias("match"))

    def after(acc: Column, s: Column) -> Column:
        one = F.array(F.struct(s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), s["match"].alias("match")))
        free = s["match"].isNotNull() & (s["start"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)))
        return F.when(free, F.concat(acc, one)).otherwise(acc)

    return F.aggregate(F.transform(starts, best), F.array().cast(_SPANS), after)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    likely: str  # a pattern or literal that any text with a match holds
    check: object
    score: float
    context: str
    whole: object = None  # from the text and the matches' spans to those to check, if others


#: In the order of reporting; the first four are the base kinds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         _always, 0.9, "mail|write|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
         lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"), 0.6, "host|server|address|adresse|dirección"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", r"[0-9](?:[\x20-]?[0-9]){15}",
         lambda m: F.call_function("luhn_check", _digits(m)), 0.8, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+",
         lambda m: F.length(_digits(m)).between(8, 15), 0.6, "phone|call|tel|mobile|fax|anruf|appel|llama"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}",
         _always, 0.7, "iban|account|konto|compte|cuenta|bank", _accounts),
    # what follows is told by its context alone, but for addresses of eight groups
    Kind("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9][A-Za-z0-9_+/-]{23,127}+(?![A-Za-z0-9_+/-])={0,2}", r"[A-Za-z0-9_+/-]{24}",
         _mixed, 0.3, "token|secret|password|passwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|contraseña|passwort|mot de passe"),
    Kind("ipv6", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]",
         _always, 0.6, "host|server|address|adresse|dirección"),
    Kind("local_phone", r"(?<![0-9+)(][\x20-])(?<![0-9+])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,4}(?![0-9])",
         r"[0-9][)\x20/-]\x20?[0-9]{3,4}[\x20-]?[0-9]{3,4}",
         _always, 0.3, "phone|call|tel|mobile|fax|anruf|appel|llama"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         _always, 0.3, "ssn|social|security|tax|national id|steuer"),
)
BASE = ("email", "ip", "card", "phone")


def _placed(text: Column, matches: Column, pattern: str) -> Column:
    """Matches with their places in code points: text = gap match gap match ..."""
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, gm: Column) -> Column:
        start = acc["pos"] + F.length(gm["gap"])
        end = start + F.length(gm["match"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), gm["match"].alias("match")))
        return F.struct(end.alias("pos"), F.concat(acc["spans"], one).alias("spans"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPANS).alias("spans"))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def find_personal_data(docs: DataFrame, text: str = "text", near: int = 40, raised: float = 0.3, least: float = 0.5) -> DataFrame:
    """``docs`` (all columns) with ``spans`` added: array of (kind, start, end,
    score) in code points, end exclusive, by kind as in KINDS, then start.

    A kind's matches are leftmost and don't overlap; one that fails its check
    is dropped without another try inside it, but for account numbers, which
    are tried at each place they may start. Null and empty texts have an
    empty array; rows are independent of each other, so repeated rows and
    null ids need no rule; a column named ``spans`` is replaced, other names
    don't matter; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c != "spans"]
    empty = F.array().cast("array<string>")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_body"))
    likely = lambda k: F.contains(F.col("_body"), F.lit(k.likely)) if len(k.likely) == 1 else F.col("_body").rlike(k.likely)
    out = out.withColumns({f"_m_{k.name}": F.when(likely(k), F.regexp_extract_all("_body", F.lit(k.pattern), F.lit(0))).otherwise(empty) for k in KINDS})
    out = out.withColumns({f"_s_{k.name}": F.when(F.size(f"_m_{k.name}") > 0, _placed(F.col("_body"), F.col(f"_m_{k.name}"), k.pattern))
                           .otherwise(F.array().cast(_SPANS)) for k in KINDS})
    out = out.withColumns({f"_s_{k.name}": F.when(F.size(f"_s_{k.name}") > 0, k.whole(F.col("_body"), F.col(f"_s_{k.name}")))
                           .otherwise(F.col(f"_s_{k.name}")) for k in KINDS if k.whole})

    def scored(k: Kind) -> Column:
        def one(s: Column) -> Column:
            first = F.greatest(s["start"] - near, F.lit(0))
            around = F.concat(F.substring(F.col("_body"), first + 1, s["start"] - first), F.lit(" "),
                              F.substring(F.col("_body"), s["end"] + 1, F.lit(near)))
            score = F.lit(k.score) + F.when(F.lower(around).rlike(rf"\b(?:{k.context})"), raised).otherwise(0.0)
            return F.struct(F.lit(k.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

        return F.transform(F.filter(F.col(f"_s_{k.name}"), lambda s: k.check(s["match"])), one)

    spans = F.filter(F.concat(*map(scored, KINDS)), lambda s: s["score"] >= least)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names], spans.alias("spans"))
