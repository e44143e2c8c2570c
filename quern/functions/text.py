"""Text expressions: stripping, extraction of differently shaped records, pre-tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text, as a list and as a class.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP = rf"^[{SPACE}]+|[{SPACE}]+\z"
#: Fixed value: ordered alternatives of the pre-tokenizer, in a form that Java and RE2 read alike.
PRETOKEN = (
    r"[A-Za-z_][\p{L}\p{N}_]*|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|\p{Nd}+(?:\.\p{Nd}*)?(?:[eE][+-]?\p{Nd}+)?"
    r"|->|::|\.\.\.|\*\*|//|<<=|>>=|<<|>>|[+\-*/%&|^]=|==|!=|<=|>=|:=|[ \t]+|\r?\n|[^\n]"
)
MIN_CHARS = 50
MAX_CHARS = 65_536
TOKENIZER_CHARS = 4_096


def strip(text: Column) -> Column:
    """``text`` without the white space at its ends; only the ends are looked at."""
    return F.btrim(text, F.lit(SPACES))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, before any stripping; else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def plain_text(text: Column, content: Column) -> Column:
    return strip(first_filled(text, content))


def _answered(problem: Column, solution: Column) -> Column:
    both = (problem != "") & (solution != "")
    return F.when(both, F.concat(F.lit("Problem: "), problem, F.lit("\n\nSolution:\n"), solution)).otherwise("")


def code_exercise(problem: Column, solution: Column, lang: Column) -> Column:
    """Both parts, after a comment that names the language where there is one."""
    p, s = strip(first_filled(problem)), strip(first_filled(solution))
    head = F.when(first_filled(lang) != "", F.concat(F.lit("# "), lang, F.lit("\n"))).otherwise("")
    return F.when((p != "") & (s != ""), F.concat(head, _answered(p, s))).otherwise("")


def solved_problem(problem: Column, question: Column, solution: Column, generated: Column) -> Column:
    return _answered(strip(first_filled(problem, question)), strip(first_filled(solution, generated)))


def solved_instruction(problem: Column, question: Column, solution: Column, generated: Column) -> Column:
    return _answered(strip(first_filled(problem, question)), strip(first_filled(generated, solution)))


def conversation(turns: Column) -> Column:
    """Texts of ``array<struct<value, content>>`` in order, without empty ones, two line ends between."""
    texts = F.transform(turns, lambda t: strip(first_filled(t["value"], t["content"])))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")


def extract(fmt: Column, record: dict[str, Column]) -> Column:
    """The text of a record by its format; '' for an unknown one."""
    r = lambda name: record.get(name, F.lit(None).cast("string"))
    solved = (r("problem"), r("question"), r("solution"), r("generated_solution"))
    return (
        F.when(fmt == "text", plain_text(r("text"), r("content")))
        .when(fmt == "magicoder", code_exercise(r("problem"), r("solution"), r("lang")))
        .when(fmt == "problem_solution", solved_problem(*solved))
        .when(fmt == "math_instruct", solved_instruction(*solved))
        .when(fmt == "conversations", conversation(record["turns"]) if "turns" in record else F.lit(""))
        .otherwise("")
    )


def pretokens(text: Column) -> Column:
    """Consecutive pre-tokens; put together they are the text again."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
