"""Classification and rule-based translation of measure texts.

Rules are column expressions applied to every row of a catalog. Comments go, literals, operators
and names that are no plain words are turned into marks first, so that a rule sees tokens and not
what happens to be inside them. A text is rewritten from its innermost calls outwards; what a rule
puts next to an operator that binds more tightly gets parentheses. What no rule covers stays visible
as an open parenthesis, a free comma or an operator that isn't on the list, and is reported as
`untranslated`, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from metricloom.functions.text import WINDOW_TYPE, snake_case, uses_over, without_comments
from metricloom.plans.settle import spread

# Patterns by class, in order of priority. The first match decides.
PATTERNS = [
    ("unsupported", r"\b(RANKX?|TOPN|TOPCOUNT|BOTTOMCOUNT)\s*\("),
    ("unsupported", r"\b(USERELATIONSHIP|CROSSFILTER|ALLSELECTED|EARLIER|CONCATENATEX)\s*\("),
    ("unsupported", r"\b(GENERATE|CROSSJOIN|LINKMEMBER|FORMAT)\s*\(|\b(SCOPE|FREEZE)\b"),
    ("unsupported", r"\.(PARENT|PREVMEMBER|NEXTMEMBER)\b|\.(LAG|LEAD|PROPERTIES)\s*\("),
    ("time_intelligence", r"\b(SAMEPERIODLASTYEAR|DATEADD|DATESINPERIOD|LASTDATE|FIRSTDATE)\s*\("),
    ("time_intelligence", r"\b(PARALLELPERIOD|LASTPERIODS|CLOSINGPERIOD|OPENINGPERIOD)\s*\("),
    ("window", r"\b(TOTALYTD|TOTALQTD|TOTALMTD|YTD|PERIODSTODATE|CLOSINGBALANCEMONTH)\s*\("),
]

# Characters that stand for parts already translated, so that the next round sees only what is left:
# ( ) , of finished calls; the filter list of an aggregate; parentheses inside conditions; a literal.
OPEN, CLOSE, COMMA, FILTERS, AND, COND_OPEN, COND_CLOSE, LIT = "⟨", "⟩", "‚", "‖", "¦", "⟦", "⟧", "§"

# Both languages and SQL agree that AND binds more tightly than OR, and both less than comparisons.
BOTH, EITHER = "∧", "∨"
# Characters of names that are no plain words, and what stands for them until the text is finished.
SPECIAL = "()[]{},%-+*/&^=<>|!'\"#$@:;~?.\\"
HIDDEN = "".join(chr(0xE000 + i) for i in range(len(SPECIAL)))
NAME = r"(?:[\w.]|`[^`]*`)+"
# What an expression may hold besides names, numbers and marks: - + * / comparisons, AND, OR, NOT, IN, IS NULL, CASE.
FORBIDDEN = r"[\^&|!~%;:@#$\\?\"']|--|//|/\*|[=<>]\s*NULL\b|\bNULL\s*[-+*/=<>]|[-+*/]\s*NULL\b"
KEYWORD = r"(?:AND|OR|THEN|ELSE|END|WHEN|IN|IS|NOT|FILTER)\b"
# Two terms without an operator between them.
ADJACENT = rf"(?i)(?:⟩|§\d+§)\s*(?!{KEYWORD})[\w⟨`]|(?<![\w.`])(?!CASE\b|{KEYWORD})[\w.`]+\s+⟨"

ARG = r"([^(),]*)"
AGG = r"(?:SUM|COUNT|AVG|MIN|MAX)⟨[^⟨⟩]*⟩"
GROUP = "⟨[^⟨⟩]*⟩"
for _ in range(5):
    GROUP = f"⟨(?:[^⟨⟩]|{GROUP})*⟩"
# A term that needs no parentheses beside a division.
TERM = rf"(?:\w*{GROUP}|{NAME})"
MEMBER = r"\[[^\]]+\](?:\.\[[^\]]+\])*"


# Functions over the rows of a table and their aggregates.
ROWS = {"COUNTROWS": "COUNT", "SUMX": "SUM", "AVERAGEX": "AVG", "MINX": "MIN", "MAXX": "MAX", "COUNTX": "COUNT"}

# Names that rules are about. Rules make no names, so that a text that lacks one at first will not get it.
WORDS = ("RELATED", "X", "FILTER", "DISTINCTCOUNT", "COUNTROWS", "AVERAGE", "AVG", "SUM", "COUNT", "MIN", "MAX", "CALCULATE", "DIVIDE", "SWITCH", "IF", LIT)


def classify(c: Column) -> Column:
    """supported, window, time_intelligence or unsupported."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, pattern in PATTERNS:
        out = out.when(c.rlike("(?i)" + pattern), kind)
    return out.otherwise("supported")


def _bind(value: Column, fn) -> Column:
    """`fn` of a value that is computed once, however often `fn` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _where(value: Column, found: Column, fn) -> Column:
    """`fn` of a text if `found`, else the text as it is."""
    return _bind(value, lambda text: F.when(found, fn(text)).otherwise(text))


def _words(value: Column) -> Column:
    """Which of the `WORDS` a text holds, in any case."""
    listed = F.array(*map(F.lit, WORDS))
    return _bind(F.upper(value), lambda text: F.filter(listed, lambda word: F.contains(text, word)))


def _each(value: Column, pattern: str, fn) -> Column:
    """Replace every match of a pattern by a function of it, longest matches first."""

    def replaced(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        by_length = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
        return F.aggregate(by_length, text, lambda acc, r: F.replace(acc, r, fn(r)))

    return _bind(value, replaced)


def _hide_literals(text: Column, literals: Column, pattern: str) -> Column:
    pieces = F.split(text, pattern)
    return F.array_join(
        F.transform(
            pieces,
            lambda p, i: F.when(
                i < F.size(literals), F.concat(p, F.lit(LIT), i.cast("string"), F.lit(LIT))
            ).otherwise(p),
        ),
        "",
    )


def _show_literals(text: Column, literals: Column) -> Column:
    def sql(x: Column) -> Column:
        body = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        return F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("''")), F.lit("'"))

    numbered = F.transform(literals, lambda x, i: F.struct(i.cast("string").alias("i"), sql(x).alias("s")))
    return F.aggregate(
        numbered, text, lambda acc, x: F.replace(acc, F.concat(F.lit(LIT), x["i"], F.lit(LIT)), x["s"])
    )


def _variables(value: Column) -> Column:
    """VAR a = x VAR b = y RETURN z: the last expression with the variables put in."""
    found = r"(?i)\bVAR (\w+) ?= ?(.+?)(?= VAR \w+ ?=| RETURN )"

    def put(text: Column) -> Column:
        pairs = F.arrays_zip(
            F.regexp_extract_all(text, F.lit(found), F.lit(1)).alias("name"),
            F.regexp_extract_all(text, F.lit(found), F.lit(2)).alias("body"),
        )
        last = F.regexp_extract(text, r"(?i)\bRETURN (.+)$", 1)

        def one(acc: Column, v: Column) -> Column:
            use = F.concat(F.lit(r"(?<![\w\[.])"), v["name"], F.lit(r"(?![\w\]\[(])"))
            body = F.replace(F.replace(v["body"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
            return F.regexp_replace(acc, use, F.concat(F.lit("("), body, F.lit(")")))

        return F.when(text.rlike(r"(?i)^VAR \w+ ?="), F.aggregate(F.reverse(pairs), last, one)).otherwise(text)

    return _bind(value, put)


def _identifier(name: Column) -> Column:
    """A column's name as SQL; quoted, with its special characters hidden, unless it is a plain word."""
    quoted = F.concat(F.lit("`"), F.translate(F.replace(name, F.lit("`"), F.lit("``")), SPECIAL, HIDDEN), F.lit("`"))
    return F.when(name.rlike(r"^\w+$"), name).otherwise(quoted)


def _dax_columns(text: Column) -> Column:
    """`Sales[Amount]` -> `amount`; columns of other tables get their join name."""
    def physical(ref: Column) -> Column:
        table = F.regexp_extract(ref, r"^'?([^'\[]+)'?\[", 1)
        col = F.regexp_extract(ref, r"\[([^\]]+)\]", 1)
        mapped = _identifier(F.coalesce(F.try_element_at(F.col("col_map"), F.concat(table, F.lit("."), col)), snake_case(col)))
        alias = F.regexp_replace(snake_case(F.regexp_replace(table, "^Dim(?=[A-Z])", "")), "^dim_", "")
        return F.when(table == F.col("source_table"), mapped).otherwise(F.concat(alias, F.lit("."), mapped))

    return _each(text, r"(?:'[^']+'|\b\w+)\[[^\]]+\]", physical)


def _mdx_names(text: Column) -> Column:
    """Members, base measures and attribute sets of a cube text to columns and conditions."""
    plain = lambda ref: snake_case(F.regexp_extract(ref, r"\[([^\]]+)\][^\[\]]*$", 1))
    last = lambda ref: _identifier(plain(ref))
    text = F.regexp_replace(text, r"(?i)" + MEMBER + r"\.CURRENTMEMBER\s+IS\s+", "")
    # [Status].&"x" -> status = "x"
    text = _each(
        text,
        MEMBER + r"\.&§\d+§",
        lambda r: F.concat(
            _identifier(snake_case(F.regexp_extract(r, r"\[([^\]]+)\]\.&", 1))), F.lit(" = "), F.regexp_extract(r, r"§\d+§", 0)
        ),
    )
    text = _each(
        text,
        r"(?i)\b(?:SUM|COUNT|AVG|MIN|MAX)\(\s*\[Measures\]\.\[[^\]]+\]\s*\)",
        lambda r: F.concat(F.upper(F.regexp_extract(r, r"^\w+", 0)), F.lit("("), last(r), F.lit(")")),
    )
    text = _each(
        text,
        r"(?i)\bDISTINCTCOUNT\(\s*" + MEMBER + r"\.MEMBERS\s*\)",
        lambda r: F.concat(F.lit("DISTINCTCOUNT("), last(r), F.lit(")")),
    )
    # A product of base measures is a product per row.
    base = r"\[Measures\]\.\[[^\]]+\]"
    product = rf"^\s*({base}(?:\s*\*\s*{base})+)\s*$"
    text = _each(text, product, lambda r: F.concat(F.lit("SUM("), _each(r, base, last), F.lit(")")))
    # A base measure sums the column of its name, provided the fact table is known to have it.
    columns = F.coalesce(F.col("fact_columns"), F.array().cast("array<string>"))
    return _each(
        text,
        r"\[Measures\]\.\[[^\]]+\]",
        lambda r: F.when(
            F.array_contains(columns, plain(r)), F.concat(F.lit("SUM("), last(r), F.lit(")"))
        ).otherwise(r),
    )


def _conditions(given: Column) -> Column:
    """Conditions separated by commas, one each, OR in parentheses."""

    def one(x: Column) -> Column:
        x = F.regexp_replace(F.trim(x), r"\s*(<>|>=|<=|=|<|>)\s*", " $1 ")
        either = F.concat(F.lit(COND_OPEN), x, F.lit(COND_CLOSE))
        return F.when(x.contains(EITHER), either).otherwise(x)

    return F.transform(F.split(given, ","), one)


def _named(condition: Column) -> Column:
    """Columns that a condition compares."""
    return F.regexp_extract_all(condition, F.lit(rf"({NAME}) (?:=|<>|>=|<=|<|>|(?i:IN|IS)\b)"), F.lit(1))


def _filter_all(call: Column, given: Column) -> Column:
    """Add conditions to the filter list of every aggregate in a text.

    A condition inside replaces one from outside on the same column: the outer one is left out there.
    """

    def one(found: Column) -> Column:
        has = lambda column: F.rlike(found, F.concat(F.lit(r"(?<![\w.`])\Q"), column, F.lit(r"\E(?![\w.`])")))
        added = F.filter(_conditions(given), lambda c: ~F.exists(_named(c), has))
        added = F.array_join(F.transform(added, lambda c: F.concat(F.lit(AND), c)), "")
        return F.concat(F.substring(found, F.lit(1), F.length(found) - 1), added, F.lit("⟩"))

    return _each(call, r"‖[^‖⟩]*⟩", one)


def _replaceable(call: Column, given: Column) -> Column:
    """No condition over several columns meets one of them inside: what of it would be replaced can't be said."""
    inside = F.array_join(F.regexp_extract_all(call, F.lit(r"‖[^‖⟩]*⟩"), F.lit(0)), " ")
    has = lambda column: F.rlike(inside, F.concat(F.lit(r"(?<![\w.`])\Q"), column, F.lit(r"\E(?![\w.`])")))
    return F.forall(_conditions(given), lambda c: (F.size(F.array_distinct(_named(c))) <= 1) | ~F.exists(_named(c), has))


def _conditions_only(given: Column) -> Column:
    """Every argument compares something."""
    return F.forall(F.split(given, ","), lambda x: x.rlike(r"(?i)[=<>]| IN ⟦| IS (NOT )?NULL"))


def _apply_filters(value: Column, pattern: str, inner: int, conds: int) -> Column:
    """Rewrite the first call that matches as its inner expression under conditions."""

    def rewritten(acc: Column) -> Column:
        call = F.regexp_extract(acc, pattern, 0)
        body = F.trim(F.regexp_extract(acc, pattern, inner))
        given = F.regexp_replace(F.regexp_extract(acc, pattern, conds), r"^[\s,]+|[\s,]+$", "")
        # Parentheses stay around an inner expression of several terms.
        done = F.regexp_replace(
            F.concat(F.lit(OPEN), _filter_all(body, given), F.lit(CLOSE)), f"^⟨({AGG})⟩$", "$1"
        )
        usable = (call != "") & body.contains(FILTERS) & _conditions_only(given) & _replaceable(body, given)
        return F.when(usable, F.replace(acc, call, done)).otherwise(acc)

    return _bind(value, rewritten)


def _lists(text: Column) -> Column:
    """`IN {1, 2}` with marks instead of braces and commas; TRUE() and BLANK() without parentheses."""
    text = _each(text, r"(?i)\bIN\s*\{[^{}]*\}", lambda r: F.concat(F.lit("IN "), F.translate(F.regexp_extract(r, r"\{.*\}", 0), "{},", COND_OPEN + COND_CLOSE + COMMA)))
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\bTRUE\(\s*\)", "TRUE"), r"(?i)\bBLANK\(\s*\)", "NULL")


def _operators(text: Column) -> Column:
    """Logical operators as marks, one sign for equality, comparisons with nothing as tests for it."""
    for pattern, to in (
        (r"\s*&&\s*", f" {BOTH} "),
        (r"\s*\|\|\s*", f" {EITHER} "),
        (r"==", "="),
        (r"(?i)\s*<>\s*NULL\b", " IS NOT NULL"),
        (r"(?i)(?<![<>])\s*=\s*NULL\b", " IS NULL"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def _filtered_rows(value: Column) -> Column:
    """Iterators over FILTER(table, condition): the aggregate under that condition."""
    names = F.create_map(*[F.lit(x) for pair in ROWS.items() for x in pair])

    def rewritten(acc: Column) -> Column:
        pattern = rf"(?i)\b({'|'.join(ROWS)})\(\s*FILTER\(\s*[\w' ]+,([^(),‖]+)\)\s*(?:,([^(),‖]+))?\)"
        part = lambda i: F.regexp_extract(acc, pattern, i)
        counts = F.upper(part(1)) == "COUNTROWS"
        body = F.when(counts, "1").otherwise(F.trim(part(3)))
        aggregate = F.concat(F.try_element_at(names, F.upper(part(1))), F.lit("⟨"), body, F.lit("‖⟩"))
        usable = (part(0) != "") & _conditions_only(part(2)) & (counts == (F.trim(part(3)) == ""))
        return F.when(usable, F.replace(acc, part(0), _filter_all(aggregate, part(2)))).otherwise(acc)

    return _bind(value, rewritten)


def _switch(value: Column) -> Column:
    """SWITCH(x, v, r, ..., other) as CASE x WHEN v THEN r ..., and CASE WHEN for SWITCH(TRUE, ...)."""

    def rewritten(acc: Column) -> Column:
        call = F.regexp_extract(acc, r"(?i)\bSWITCH\(([^()]*)\)", 0)
        given = F.transform(F.split(F.regexp_extract(call, r"\((.*)\)", 1), ","), lambda x: F.trim(x))
        subject, rest = F.get(given, F.lit(0)), F.slice(given, F.lit(2), F.greatest(F.size(given) - 1, F.lit(0)))
        arms = F.transform(
            F.filter(rest, lambda x, i: (i % 2 == 0) & (i + 1 < F.size(rest))),
            lambda x, i: F.concat(F.lit("WHEN "), x, F.lit(" THEN "), F.get(rest, i * 2 + 1)),
        )
        head = F.when(F.upper(subject) == "TRUE", F.lit("CASE ")).otherwise(F.concat(F.lit("CASE "), subject, F.lit(" ")))
        other = F.when(F.size(rest) % 2 == 1, F.concat(F.lit(" ELSE "), F.element_at(rest, -1))).otherwise(F.lit(""))
        done = F.concat(head, F.array_join(arms, " "), other, F.lit(" END"))
        usable = (call != "") & call.contains(FILTERS) & (F.size(given) > 2)
        return F.when(usable, F.replace(acc, call, done)).otherwise(acc)

    return _bind(value, rewritten)


def _round(acc: Column, mdx: Column, words: Column) -> Column:
    """One pass over the innermost calls. Rules about a function are tried on texts that hold its name, see `_words`."""
    def sub(pattern: str, to: str):
        return lambda text: F.regexp_replace(text, pattern, to)

    def has(word: str) -> Column:
        return F.array_contains(words, word)

    def rules(found: Column | None, *some) -> None:
        nonlocal acc

        def all_of(text: Column) -> Column:
            for rule in some:
                text = rule(text)
            return text

        acc = all_of(acc) if found is None else _where(acc, found, all_of)

    rules(has("RELATED"), sub(rf"(?i)\bRELATED\(\s*({NAME})\s*\)", "$1"))
    # IF per row, inside an iterator.
    rowwise = rf"(?i)\b((?:{'|'.join(ROWS)})\(\s*[\w' ]+,[^()]*?)\bIF\(\s*([^(),‖]+?)\s*,\s*([^(),‖]+?)\s*"
    iterators = lambda *some: rules(has("X") | has("COUNTROWS"), *some)
    iterators(
        lambda text: _where(
            text, has("IF"),
            lambda t: sub(rowwise + r",\s*([^(),‖]+?)\s*\)", "$1CASE WHEN $2 THEN $3 ELSE $4 END")(sub(rowwise + r"\)", "$1CASE WHEN $2 THEN $3 END")(t)),
        ),
        lambda text: _where(text, has("FILTER"), _filtered_rows),
    )
    rules(has("DISTINCTCOUNT"), sub(r"(?i)\bDISTINCTCOUNT\(\s*([^(),‖]+?)\s*\)", "COUNT⟨DISTINCT $1‖⟩"))
    rules(has("COUNTROWS"), sub(r"(?i)\bCOUNTROWS\(\s*[\w' ]+\s*\)", "COUNT⟨1‖⟩"))
    for name, fn in (("AVERAGE", "AVG"), ("AVG", "AVG"), ("SUM", "SUM"), ("COUNT", "COUNT"), ("MIN", "MIN"), ("MAX", "MAX")):
        rules(has(name), sub(rf"(?i)\b{name}\(\s*([^(),‖]+?)\s*\)", f"{fn}⟨$1‖⟩"))
    iterators(*[sub(rf"(?i)\b{name}\(\s*[\w' ]+,\s*([^(),‖]+?)\s*\)", f"{fn}⟨$1‖⟩") for name, fn in list(ROWS.items())[1:]])
    for divisor in (r"/\s*\(\s*([^(),]+?)\s*\)", rf"/\s*({AGG})"):
        # In cubes every division is a safe one.
        rules(mdx, sub(divisor, "/ NULLIF⟨$1‚ 0⟩"))
    rules(None, sub(rf"(?<![\w⟩])\(\s*({AGG})\s*\)", "$1"))
    rules(has("CALCULATE"), lambda text: _apply_filters(text, rf"(?i)\bCALCULATE\({ARG},([^()⟨⟩]*)\)", 1, 2))
    rules(has("IF"), lambda text: _apply_filters(text, r"(?i)\bIIF\(\s*(\w+ = §\d+§)\s*,([^(),]*),\s*NULL\s*\)", 2, 1))
    rules(has(LIT), lambda text: _apply_filters(text, r"(?<!\w)\(((?:\s*\w+ = §\d+§\s*,)+)([^(),]*)\)", 2, 1))
    # CALCULATE without conditions, as it is left when a time function was taken out.
    rules(
        has("CALCULATE"),
        sub(rf"(?i)\bCALCULATE\(\s*({AGG})\s*\)", "$1"),
        sub(r"(?i)\bCALCULATE\(\s*([^(),]*‖[^(),]*?)\s*\)", "⟨$1⟩"),
    )
    # Zero denominators give the alternate; none, 0 and NULL are the plain NULL. A numerator of several terms keeps together.
    none = r"(?:,\s*(?:0(?:\.0*)?|NULL|)\s*)?"
    divisions = []
    for numerator, shown in ((rf"({TERM})", "$1"), (r"([^(),]+?)", "⟨$1⟩")):
        two = rf"\s*{numerator}\s*,\s*([^(),]+?)\s*"
        divisions.append(sub(rf"(?i)^\s*DIVIDE\({two}{none}\)\s*$", f"{shown} / NULLIF⟨$2‚ 0⟩"))
        divisions.append(sub(rf"(?i)\bDIVIDE\({two}{none}\)", f"⟨{shown} / NULLIF⟨$2‚ 0⟩⟩"))
        divisions.append(sub(rf"(?i)\bDIVIDE\({two},\s*([^(),]+?)\s*\)", f"COALESCE⟨{shown} / NULLIF⟨$2‚ 0⟩‚ $3⟩"))
    rules(has("DIVIDE"), *divisions)
    rules(has("SWITCH"), _switch)
    rules(
        has("IF"),
        sub(r"(?i)\bI?IF\(\s*([^(),]*‖[^(),]*?)\s*,\s*([^(),]+?)\s*\)", "CASE WHEN $1 THEN $2 END"),
        sub(
            r"(?i)\bI?IF\(\s*([^(),]*‖[^(),]*?)\s*,\s*([^(),]+?)\s*,\s*([^(),]+?)\s*\)",
            "CASE WHEN $1 THEN $2 ELSE $3 END",
        ),
    )
    rules(None, sub(rf"(?<![\w⟩])\(\s*({AGG}|{GROUP})\s*\)", "$1"))
    rules(None, sub(rf"(?<![\w⟩])\((?!\s*(?:{AGG}|{GROUP})\s*\))\s*([^(),]+?)\s*\)", "⟨$1⟩"))
    return acc


def _finish(text: Column) -> Column:
    """Plain SQL from the marked text."""
    text = F.regexp_replace(text, "‖⟩", "⟩")
    text = F.regexp_replace(text, "‖¦", "⟩ FILTER ⟨WHERE ")
    text = F.regexp_replace(F.regexp_replace(text, f"{AND}| ?{BOTH} ?", " AND "), f" ?{EITHER} ?", " OR ")
    return F.translate(text, OPEN + CLOSE + COMMA + COND_OPEN + COND_CLOSE + HIDDEN, "(),()" + SPECIAL)


# Wrappers around a whole measure, and what stays of it. A date column is table[column]; what else a time function is given
# are conditions, or no rule applies.
DATES = r"(?:'[^']+'|\w+)\[[^\]]+\]"
CONDITIONS = r"([^()]*[=<>][^()]*|[^()]*\bIN\s*\{[^()]*)"
SHIFT = r"(?:SAMEPERIODLASTYEAR|DATEADD|LASTDATE)\([^()]*\)"
TO_DATE = [
    (rf"(?is)^TOTAL(?:YTD|QTD|MTD)\((.+),\s*{DATES}\s*\)$", "$1"),
    (rf"(?is)^TOTAL(?:YTD|QTD|MTD)\((.+?),\s*{DATES}\s*,{CONDITIONS}\)$", "CALCULATE($1,$2)"),
    (r"(?is)^(?:AGGREGATE|SUM)\(\s*(?:PERIODSTODATE|YTD)\([^()]*\)\s*,(.+)\)$", "$1"),
]
SHIFTED = [
    (rf"(?is)^CALCULATE\((.+),\s*{SHIFT}\s*\)$", "CALCULATE($1)"),
    (rf"(?is)^CALCULATE\((.+?),\s*{SHIFT}\s*,{CONDITIONS}\)$", "CALCULATE($1,$2)"),
    (r"(?is)^\(\s*(?:PARALLELPERIOD|CLOSINGPERIOD)\([^()]*\)\s*,(.+)\)$", "$1"),
    (r"(?is)^AVG\(\s*LASTPERIODS\([^()]*\)\s*,(.+)\)$", "AVG($1)"),
]


def _unwrap(text: Column) -> Column:
    """The measure inside a time function; one wrapper at most, as a window stands for one."""
    out = F.when(F.lit(False), text)
    for pattern, inner in (*TO_DATE, *SHIFTED):
        out = out.when(text.rlike(pattern), F.trim(F.regexp_replace(text, pattern, inner)))
    return out.otherwise(text)


def _window_range(text: Column) -> Column:
    """Range that approximates a shifted or rolling period; null where there is none."""
    part = lambda pattern, i: F.regexp_extract(text, "(?i)" + pattern, i)
    shift = r"\bDATEADD\([^()]*,\s*(-?)(\d+)\s*,\s*(\w+)"
    level = r"\bPARALLELPERIOD\([^(),]*\[(\w+)\]\s*,\s*(-?)(\d+)"
    rolling = part(r"\bLASTPERIODS\(\s*(\d+)", 1)
    span = lambda ahead, n, unit: F.concat(F.when(ahead, "leading ").otherwise("trailing "), n, F.lit(" "), F.lower(unit))
    return (
        F.when(text.rlike(r"(?i)\bSAMEPERIODLASTYEAR\b"), "trailing 1 year")
        .when(part(level, 3) != "", span(part(level, 2) == "-", part(level, 3), part(level, 1)))
        .when(part(shift, 2) != "", span(part(shift, 1) == "", part(shift, 2), part(shift, 3)))
        .when(rolling != "", F.concat(F.lit("trailing "), rolling, F.lit(" month")))
        .when(text.rlike(r"(?i)\b(LASTDATE|CLOSINGPERIOD)\b"), "current")
    )


# First and last parts of the names of to-date functions.
PERIOD_OF = {"TOTALQTD": "quarter", "TOTALMTD": "month"}

# What tells rows of the staging table apart.
SPREAD = ("model", "measure_name", "position", "measure_expr")


def translate_rules(staging: DataFrame) -> DataFrame:
    """Pending rows with the answer columns (B6): class, expr, window, warning, needs.

    Works on `resolved_expr` where there is one. A row without `expr` and with a warning of type
    `untranslated` met no rule. A row is little to read and much to translate, so rows are spread first.
    """
    df = spread(staging.where("final_status = 'pending'"), *[c for c in SPREAD if c in staging.columns])
    mdx = F.col("mode") == "mdx"
    raw = F.trim(without_comments(F.coalesce("resolved_expr", "measure_expr")))
    df = df.withColumn("class", classify(raw))
    df = df.withColumn("__raw", F.when(mdx, F.regexp_replace(raw, r"&\[([^\]]+)\]", '&"$1"')).otherwise(raw))
    df = df.withColumn("__inner", _unwrap(F.col("__raw")))
    quoted = r'"(?:[^"]|"")*"'
    df = df.withColumn("__lits", F.regexp_extract_all("__inner", F.lit(quoted), F.lit(0)))
    hidden = F.regexp_replace(_hide_literals(F.col("__inner"), F.col("__lits"), quoted), r"\s+", " ")
    df = df.withColumn("__text", hidden)
    named = F.when(mdx, _mdx_names(F.col("__text"))).otherwise(_dax_columns(_variables(_lists(F.col("__text")))))
    df = df.withColumn("__text", _operators(named))
    # A round closes the innermost parentheses, so there are never more rounds than parentheses.
    opened = F.length("__text") - F.length(F.replace(F.col("__text"), F.lit("("), F.lit("")))
    df = df.withColumn("__rounds", F.sequence(F.lit(0), opened))
    df = df.withColumns({"__mdx": mdx, "__words": _words(F.col("__text"))})
    # A text without open parentheses is finished.
    step = lambda acc, i: F.when(acc.contains("("), _round(acc, F.col("__mdx"), F.col("__words"))).otherwise(acc)
    # A value that depends on the task keeps conditions on what follows above this step; below, the plan would repeat all rules in each.
    done = F.aggregate("__rounds", F.col("__text"), step)
    df = df.withColumn("__text", F.when(F.spark_partition_id() >= 0, done))
    closed = ~F.col("__text").rlike(r"[()\[\]{},]|(?i)\b(VAR|RETURN|BLANK|CURRENTMEMBER|ALL|VALUES)\b")
    closed = closed & ~F.col("__text").rlike(FORBIDDEN) & ~F.col("__text").rlike(ADJACENT)
    translated = closed & F.col("__text").contains(FILTERS)
    sql = F.trim(_show_literals(_finish(F.col("__text")), F.col("__lits")))
    kind = F.col("class")
    df = df.withColumn("expr", F.when(translated & (kind != "unsupported"), sql))
    calendar = F.get(
        F.filter(
            F.coalesce("dim_tables", F.array().cast(dict(staging.dtypes)["dim_tables"])),
            lambda d: d["alias"].rlike("calendar|date") | (d["dim_key"] == "date"),
        ),
        F.lit(0),
    )
    df = df.withColumn("__cal", calendar)
    timed = kind.isin("window", "time_intelligence") & F.col("expr").isNotNull() & F.col("__cal").isNotNull()
    span = _window_range(F.col("__raw"))
    timed = timed & ((kind == "window") | span.isNotNull())
    df = df.withColumn("expr", F.when(kind.isin("window", "time_intelligence") & ~timed, None).otherwise(F.col("expr")))
    period = F.lit("year")
    for fn, unit in PERIOD_OF.items():
        period = F.when(F.col("__raw").rlike(rf"(?i)\b{fn}\("), unit).otherwise(period)
    entry = lambda order, span: F.struct(
        F.lit(order).alias("order") if isinstance(order, str) else order.alias("order"),
        F.lit(span).alias("range") if isinstance(span, str) else span.alias("range"),
        F.lit("last").alias("semiadditive"),
    )
    df = df.withColumn(
        "window",
        F.when(timed & (kind == "window"), F.array(entry("date", "cumulative"), entry(period, "current")))
        .when(timed, F.array(entry("date", span)))
        .cast(WINDOW_TYPE),
    )
    df = df.withColumn("needs_window", F.col("window").isNotNull())
    warning = (
        F.when(kind == "unsupported", "unsupported_dax")
        .when(kind == "time_intelligence", "time_intelligence")
        .when(F.col("expr").isNull(), "untranslated")
    )
    df = df.withColumn("warning_type", warning)
    df = df.withColumn(
        "warning_message",
        F.when(kind == "unsupported", "no metric-view form")
        .when((kind == "time_intelligence") & F.col("expr").isNotNull(), "approximated by a window")
        .when(kind == "time_intelligence", "no window stands for this expression")
        .when(F.col("expr").isNull(), "no rule covers this expression"),
    )
    cal = F.col("__cal")
    time_dims = F.array(
        F.concat(F.lit("date:"), cal["alias"], F.lit("."), cal["dim_key"]),
        F.concat(period, F.lit(":"), cal["alias"], F.lit("."), period),
    )
    df = df.withColumn(
        "dimensions_needed",
        F.when(timed & (kind == "window"), time_dims)
        .when(timed, F.slice(time_dims, 1, 1))
        .otherwise(F.array().cast("array<string>")),
    )
    uses = lambda d: F.rlike(F.col("expr"), F.concat(F.lit(r"\b"), d["alias"], F.lit(r"\."))) | (
        F.col("needs_window") & (d["alias"] == cal["alias"])
    )
    joins = F.transform(
        F.filter("dim_tables", uses),
        lambda d: F.struct(
            d["alias"].alias("name"),
            d["table"].alias("source"),
            F.concat(F.lit("source."), d["join_key"], F.lit(" = "), d["alias"], F.lit("."), d["dim_key"]).alias("on"),
        ),
    )
    empty = F.array().cast("array<struct<name:string,source:string,on:string>>")
    df = df.withColumn("joins_needed", F.coalesce(joins, empty))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def guard_over(translated: DataFrame) -> DataFrame:
    """Drop expressions that use a SQL window and say so."""
    hit = F.coalesce(uses_over(F.col("expr")), F.lit(False))
    message = F.lit("measure uses a SQL window (OVER) and was left out")
    return translated.withColumns(
        {
            "warning_type": F.when(hit, "unsupported_dax").otherwise(F.col("warning_type")),
            "warning_message": F.when(hit, message).otherwise(F.col("warning_message")),
            "expr": F.when(~hit, F.col("expr")),
        }
    )
