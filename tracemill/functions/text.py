"""Text of traces: sentences, tokens, prefixes, extraction of traces and answers. Native columns, but for one."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F

_WHITE = r"^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """f(x), with x worked out once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def strip(x) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(_c(x), _WHITE, "")


def sentences(x) -> Column:
    """Parts between runs of sentence marks, trimmed, empty ones dropped; a null text has none."""
    parts = F.transform(F.split(F.coalesce(_c(x), F.lit("")), r"[.!?]+"), lambda s: strip(s))
    return F.filter(parts, lambda s: s != "")


def count_sentences(x) -> Column:
    return F.size(sentences(x)).cast("long")


def count_tokens(x) -> Column:
    """Words between white space; 0 for blank and null."""
    t = strip(F.coalesce(_c(x), F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def prefix_points(n, every: int) -> Column:
    """Prefix lengths 0, every, 2 * every ... and the last one, n - 1; just 0 for an empty trace."""
    last = F.greatest(_c(n) - 1, F.lit(0)).cast("long")
    return F.array_sort(F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(every).cast("long")), F.array(last)))


def prefix(sents, j, joiner: str = "\n") -> Column:
    """The first j sentences, joined."""
    return F.array_join(F.slice(_c(sents), F.lit(1), F.greatest(_c(j), F.lit(0)).cast("int")), joiner)


def partial_trace(x, j) -> Column:
    """The first j sentences joined by a space, or else j paragraphs, or else all of the text."""
    s, text, j = sentences(x), _c(x), _c(j)
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: strip(p)), lambda p: p != "")
    return F.when((j > 0) & (j < F.size(s)), prefix(s, j, " ")).when((j > 0) & (j < F.size(paragraphs)), F.array_join(F.slice(paragraphs, F.lit(1), F.greatest(j, F.lit(0)).cast("int")), "\n\n")).otherwise(text)


def completion(full, starts_at) -> Column:
    """The text from an offset (from 0) on; all of it where the offset is not positive."""
    return F.when(_c(starts_at) > 0, F.substring(_c(full), (_c(starts_at) + 1).cast("int"), F.length(_c(full)))).otherwise(_c(full))


def canonical_model(name) -> Column:
    """One key for every spelling of the same long model name; slashes become underscores."""
    low = F.lower(_c(name))
    return F.when(low.contains("deepseek") & low.contains("r1-0528"), "deepseek-ai_DeepSeek-R1-0528").otherwise(F.replace(_c(name), F.lit("/"), F.lit("_")))


def teacher_short(name) -> Column:
    """Last part of a path-like name without instruct and chat suffixes."""
    out = F.substring_index(_c(name), "/", -1)
    for suffix in ("-Instruct", "-instruct", "-Chat", "-chat"):
        out = F.regexp_replace(out, suffix + "$", "")
    return out


def student_short(name) -> Column:
    """Table-safe student name."""
    out = F.regexp_replace(F.substring_index(_c(name), "/", -1), "-[Ii]nstruct", "")
    return F.lower(F.translate(out, ".-", "__"))


# --- traces --------------------------------------------------------------------------------
# The chat templates' markers.
QWEN = ("<think>", "</think>", "<|im_start|>assistant\n", "<|im_end|>")
LLAMA_START, LLAMA_END = "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"
GEMMA_START, GEMMA_END = "<start_of_turn>model", "<end_of_turn>"
MISTRAL_START, MISTRAL_END = "[/INST]", "</s>"
PHI_START = "<|assistant|>"
GPT = ("<|start|>assistant<|channel|>analysis<|message|>", "<|end|>", "<|start|>assistant<|channel|>final<|message|>", "<|return|>")


def _has(t: Column, mark: str) -> Column:
    return F.instr(t, mark) > 0


def _after(t: Column, mark: str) -> Column:
    """Text behind the first mark."""
    return F.substring(t, F.instr(t, mark) + len(mark), F.length(t))


def _until(t: Column, mark: str) -> Column:
    return F.when(_has(t, mark), F.substring(t, F.lit(1), F.instr(t, mark) - 1)).otherwise(t)


def _without(t: Column, *marks: str) -> Column:
    for m in marks:
        t = F.replace(t, F.lit(m), F.lit(""))
    return t


def trace_of(output, model, full: bool = False) -> Column:
    """The chain of thought in a model's raw output, by model family; the raw text where markers are missing."""
    return let(F.struct(_c(output).alias("t"), F.lower(_c(model)).alias("name")), lambda p: _trace(p["t"], p["name"], full))


def _trace(t: Column, name: Column, full: bool) -> Column:
    think, unthink, turn, done = QWEN
    body = F.when(_has(t, think), _after(t, think)).when(_has(t, turn), _after(t, turn)).otherwise(t)
    cut = body if full else F.when(~_has(t, unthink), body).when(_has(body, unthink), _until(body, unthink)).otherwise(_until(body, done))
    qwen = strip(_without(cut, think, unthink, done))

    said = _after(t, LLAMA_START)
    thought = _after(said, think)
    clean = lambda x: strip(_without(x, think, unthink))
    ended = F.when(_has(thought, LLAMA_END), clean(_until(thought, LLAMA_END))).otherwise(thought)
    if not full:
        ended = F.when(_has(thought, unthink), clean(_until(thought, unthink))).otherwise(ended)
    llama = F.when(~_has(t, LLAMA_START), t).when(_has(said, think), ended).when(_has(said, LLAMA_END), _until(said, LLAMA_END)).otherwise(clean(said))

    turned = _after(t, GEMMA_START)
    gemma = F.when(~_has(t, GEMMA_START), t).when(_has(turned, GEMMA_END), strip(_without(_until(turned, GEMMA_END), GEMMA_START, GEMMA_END))).otherwise(turned)

    def between(start: str, stop: str, *drop: str) -> Column:
        rest = F.when(_has(t, start), _after(t, start)).otherwise(t)
        return strip(_without(rest if full else _until(rest, stop), start, stop, *drop))

    mistral = between(MISTRAL_START, MISTRAL_END)
    gpt = between(GPT[0], GPT[1], GPT[2], GPT[3])
    phi = F.when(_has(t, PHI_START), F.substring(t, F.instr(t, PHI_START), F.length(t))).otherwise(t)
    own = {"gpt-oss": gpt, "magistral": mistral, "gemma": gemma, "llama": llama, "phi": phi}
    out = F.when(F.lit(False), t)
    for key in FAMILIES:  # the others write as qwen does
        out = out.when(name.contains(key), own.get(key, qwen))
    return out.otherwise(t)


# --- answers -------------------------------------------------------------------------------


def _balanced(x: Column) -> Column:
    """What stands between an opening brace at the start and the brace that closes it, or the end."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(acc, c):
        depth = F.when(c == "{", acc["depth"] + 1).when(c == "}", acc["depth"] - 1).otherwise(acc["depth"])
        ends = (c == "}") & (depth == 0)
        first = (acc["depth"] == 0) & (acc["out"] == "") & (c == "{")
        out = F.when(ends | first, acc["out"]).otherwise(F.concat(acc["out"], c))
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), out.alias("out"), ends.alias("done")))

    return F.aggregate(F.split(x, ""), start, step, lambda acc: acc["out"])


#: What a stated answer stands behind, in the order in which they are tried; the last one of each counts.
ANSWER_MARKS = ("he answer is", "final answer is", "答案是", "ANSWER:")
FINAL_MARK, FINAL_END, BOX_MARK, DROPPED = "final answer is $", "$. I hope", "boxed", "ки"


def _cleaned(raw: Column, normal: bool) -> Column:
    out = F.regexp_replace(raw, r"\n\s*", "")
    for pattern in ("^:", r"\.$", "/$"):
        out = F.regexp_replace(out, pattern, "")
    return normalise_answer(out) if normal else strip(out)


def math_answer(x, normal: bool = True) -> Column:
    """The stated answer: final-answer phrase, last box, answer phrases, else the last number; '' if none.

    It is given in normal form, or as it is written.
    """
    t = F.replace(F.coalesce(_c(x), F.lit("")), F.lit(DROPPED), F.lit(""))
    box = F.substring_index(t, BOX_MARK, -1)
    boxed = F.when(box == "", "").when(F.substring(box, 1, 1) == "{", _balanced(box)).otherwise(strip(F.substring_index(box, "$", 1)))
    numbers = F.regexp_extract_all(F.replace(t, F.lit(","), F.lit("")), F.lit(r"(-?\d*\.?\d+)"), F.lit(1))
    raw = F.when(_has(t, FINAL_MARK) & _has(t, FINAL_END), strip(F.substring_index(_after(t, FINAL_MARK), FINAL_END, 1))).when(_has(t, BOX_MARK), boxed)
    for mark in ANSWER_MARKS:
        said = strip(F.substring_index(strip(_after(t, mark)), "\n\n", 1)) if mark == "答案是" else strip(F.substring_index(t, mark, -1))
        raw = raw.when(_has(t, mark), said)
    return _cleaned(raw.otherwise(F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(""))), normal)


def answer_span(x) -> Column:
    """(answer, start, end): the stated answer in normal form, and where it is written, from 0, end exclusive; -1 where there is none.

    The place is that of the match itself, however often the answer stands elsewhere; it counts characters of the text
    without the syllable that is dropped before. A phrase's last place counts; numbers keep their separators apart.
    """
    number = r"-?\d*\.?\d+"

    def behind(t: Column, at: Column, part: Column) -> Column:
        """What a part that begins at `at` says, without white space around it."""
        said = strip(part)
        return F.struct(said.alias("raw"), (at + F.when(said == "", 0).otherwise(F.length(part) - F.length(F.regexp_replace(part, r"^\s+", "")))).alias("at"))

    def place(t: Column) -> Column:
        tail = lambda mark: F.substring_index(t, mark, -1)
        start = lambda mark: F.length(t) - F.length(tail(mark))
        none = F.struct(F.lit("").alias("raw"), F.lit(-1).alias("at"))
        box = tail(BOX_MARK)
        boxed = F.when(box == "", none).when(F.substring(box, 1, 1) == "{", F.struct(_balanced(box).alias("raw"), (start(BOX_MARK) + 1).alias("at"))).otherwise(behind(t, start(BOX_MARK), F.substring_index(box, "$", 1)))
        final = F.instr(t, FINAL_MARK) + len(FINAL_MARK) - 1
        out = F.when(_has(t, FINAL_MARK) & _has(t, FINAL_END), behind(t, final, F.substring_index(_after(t, FINAL_MARK), FINAL_END, 1))).when(_has(t, BOX_MARK), boxed)
        for mark in ANSWER_MARKS:
            out = out.when(_has(t, mark), behind(t, start(mark), F.substring_index(tail(mark), "\n\n", 1) if mark == "答案是" else tail(mark)))
        found, rest = F.regexp_extract_all(t, F.lit(number), F.lit(0)), F.element_at(F.split(t, number, -1), -1)
        last = F.try_element_at(found, F.lit(-1))
        return out.when(F.size(found) > 0, F.struct(last.alias("raw"), (F.length(t) - F.length(rest) - F.length(last)).alias("at"))).otherwise(none)

    t = F.replace(F.coalesce(_c(x), F.lit("")), F.lit(DROPPED), F.lit(""))
    return let(let(t, place), lambda p: F.struct(_cleaned(p["raw"], True).alias("answer"), p["at"].alias("start"), F.when(p["at"] < 0, -1).otherwise(p["at"] + F.length(p["raw"])).alias("end")))


def choice_answer(x) -> Column:
    """Last boxed letter A to D; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(_c(x), F.lit(r"\\boxed\{([A-D])\}"), F.lit(1)), F.lit(-1))


def _groupings(text: str | None) -> dict[str, list[str] | None] | None:
    """Category to words of the last fenced json block, or else of the last balanced object that holds groupings."""
    fenced = re.findall(r"```json(.*?)```", text or "", re.DOTALL | re.IGNORECASE)
    raw = fenced[-1].strip() if fenced else None
    if raw is None:
        opened, closes = [], {}
        for m in re.finditer(r"[{}]", text or ""):
            if m[0] == "{":
                opened.append(m.start())
            elif opened:
                closes[opened.pop()] = m.end()
        for at in sorted(closes, reverse=True):
            try:
                if any(k.upper() == "GROUPINGS" for k in json.loads(text[at : closes[at]])):
                    raw = text[at : closes[at]]
                    break
            except (ValueError, RecursionError):
                continue
    try:
        groups = json.loads((raw or "").upper())["GROUPINGS"].values()
        return {str(g["CATEGORY"]): [str(w) for w in g["WORDS"]] if isinstance(g["WORDS"], list) else None for g in groups}
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return None


def connections_answer(x) -> Column:
    """Upper-cased categories and words of the reply's groupings; null if none parses.

    Balanced braces and whole JSON need Python, in Arrow batches; it is the one function here that is not native.
    The map comes back as a map: Spark's own JSON reader gives up at keys of over 50,000 characters.
    """

    @F.pandas_udf("map<string,array<string>>")
    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([_groupings(t) for t in texts], dtype=object)

    return batch(_c(x))


def clean_choice(x) -> Column:
    """Last letter A to E that stands alone, else the text without marks at its end."""
    t = F.regexp_replace(F.regexp_replace(_c(x), r"^\n+|\n+$", ""), r"\.+$", "")
    letter = F.try_element_at(F.regexp_extract_all(F.upper(t), F.lit(r"\b([A-E])\b"), F.lit(1)), F.lit(-1))
    return F.coalesce(letter, F.regexp_replace(strip(t), r"^\.+|[./]+$", ""))


def parse_number(x) -> Column:
    """A number without separators, per cent as hundredths; null if it is none."""
    t = strip(F.replace(_c(x), F.lit(","), F.lit("")))
    return F.when(t.endswith("%"), F.try_divide(F.regexp_replace(t, r"\\?%$", "").try_cast("double"), F.lit(100.0))).otherwise(t.try_cast("double"))


#: Rewrites of a stated answer, in the order that its normal form depends on. A rule is
#: (pattern, replacement), or a step of its own by name.
ANSWER_RULES = (
    (r"\n", ""), (r"\.+$", ""), (r"\\!", ""), (r"\\begin\{array\}\{.*?\}", r"\\begin{pmatrix}"), (r"\\end\{array\}", r"\\end{pmatrix}"),
    ("bmatrix", "pmatrix"), ("tfrac", "frac"), ("dfrac", "frac"), (r"\\neq", r"\\ne"), (r"\\leq", r"\\le"), (r"\\geq", r"\\ge"),
    (r"\\left", ""), (r"\\right", ""), (r"\\\{", "{"), (r"\\\}", "}"), "words in text", (r"(cm|inches)\}\^2", "$1}"), "unit at the end",
    (r"\^\{\\circ\}", ""), (r"\^\\circ", ""), (r"\\\$", ""), (r"\$", ""), (r"\\\(|\\\)", ""), "number in words", (r"\\text\{(.*?)\}", "$1"),
    (r"x=|y=|z=|x\\in|y\\in|z\\in|x\\to|y\\to|z\\to", ""), (r"\\emptyset", "{}"), (r"\(-\\infty,\\infty\)", r"\\mathbb{R}"), (r"\\?%", ""),
    (r" \.", " 0."), (r"\{\.", "{0."), ("infinity", r"\\infty"), "short infinity", ("and", ""), (r"\\mathbf", ""), (r"\\mbox\{.*?\}", ""), "imaginary unit",
    (r"(\d+)\.0*([^\d])", "$1$2"), (r"(\d+)\.0*$", "$1"), (r"^\.", "0."), (r"^[^=]{0,2}=([^=]*)$", "$1"), (r"\\sqrt(\w+)", r"\\sqrt{$1}"), (" ", ""),
    "short fractions", "plain fraction", (r"\\(?=-?\d+(\\|\)|,|\]|$))", ""), ("thgrade$", ""), "separators", "lists of integers",
)


def _answer_step(name: str, t: Column) -> Column:
    """One of the rewrites that are more than a replacement."""
    if name == "words in text":
        found = F.regexp_extract_all(t, F.lit(r"\\text\{([a-zA-Z]+)\}"), F.lit(1))
        return F.aggregate(found, t, lambda acc, w: F.when(word_number(F.lower(w)) != F.lower(w), F.replace(acc, F.concat(F.lit("\\text{"), w, F.lit("}")), word_number(F.lower(w)))).otherwise(acc))
    if name == "unit at the end":
        cut = strip(F.regexp_replace(t, r"\\text\{.*?\}$", ""))
        return F.when(cut != "", cut).otherwise(t)
    if name == "number in words":
        return word_number(t)
    if name == "short infinity":
        return F.when(F.contains(t, F.lit("\\infty")), t).otherwise(F.replace(t, F.lit("inf"), F.lit("\\infty")))
    if name == "imaginary unit":
        return F.when(F.contains(t, F.lit("i")), t).otherwise(F.replace(t, F.lit("j"), F.lit("i")))
    if name == "short fractions":  # a cut-off fraction leaves all as it is
        whole = F.regexp_replace(F.regexp_replace(t, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
        return F.when(t.rlike(r"\\frac([^{])?(\\frac|$)"), t).otherwise(whole)
    if name == "plain fraction":
        root = F.contains(t, F.lit("sqrt"))
        part = r"(-?(?:0|[1-9]\d*))"
        loose = r"(-?(?:0|[1-9]\d*)|[^/]*sqrt[^/]*)"
        return F.when(root, F.regexp_replace(t, f"^{loose}/{loose}$", r"\\frac{$1}{$2}")).otherwise(F.regexp_replace(t, f"^{part}/{part}$", r"\\frac{$1}{$2}"))
    if name == "separators":
        return F.when(t.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)
    numbers = F.transform(F.split(t, ","), lambda n: n.try_cast("decimal(38,0)"))
    return F.when(t.rlike(r"^(-?\d+,)*-?\d{1,37}$") & F.forall(numbers, lambda n: n.isNotNull()), F.array_join(F.transform(F.array_sort(numbers), lambda n: n.cast("string")), ",")).otherwise(t)


def _step_of(name: str):
    return lambda v: _answer_step(name, v)


def normalise_answer(x) -> Column:
    """Normal form of a LaTeX answer: the rules of ANSWER_RULES, one after the other."""
    t = strip(_c(x))
    for rule in ANSWER_RULES:
        t = let(t, _step_of(rule)) if isinstance(rule, str) else F.regexp_replace(t, *rule)
    return t


def scoring_text(mode: str, system, question, trace, completion_) -> Column:
    """What a reward model reads, in one of four modes; system may be null or empty for none."""
    part = lambda x: strip(F.coalesce(_c(x), F.lit("")))
    head = F.when(part(system) != "", F.concat(F.lit("System: "), part(system)))
    body = part(trace) if mode.endswith("trace") or mode == "trace_only" else part(completion_)
    if mode in ("trace_only", "completion_only"):
        return F.concat_ws("\n", head, F.when(body != "", body))
    if mode in ("question_trace", "question_completion"):
        return F.concat_ws("\n", head, F.concat(F.lit("Human: "), part(question)), F.concat(F.lit("Assistant: "), body))
    raise ValueError(f"unknown mode {mode}")


#: English number words.
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {w: 20 + 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}


def word_number(x) -> Column:
    """A number in English words as digits; any other text unchanged."""
    t = _c(x)
    words = F.filter(F.split(F.lower(strip(t)), r"[\s-]+"), lambda w: (w != "and") & (w != ""))
    small = F.create_map(*[F.lit(v) for w, n in NUMBER_WORDS.items() for v in (w, n)])
    scale = F.create_map(*[F.lit(v) for w, n in SCALES.items() for v in (w, n)])
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("part"))

    def step(acc, w):
        n, k = F.try_element_at(small, w), F.try_element_at(scale, w)
        total = F.when(k.isNotNull(), acc["total"] + F.greatest(acc["part"], F.lit(1)) * k).otherwise(acc["total"])
        part = F.when(k.isNotNull(), F.lit(0)).when(w == "hundred", F.greatest(acc["part"], F.lit(1)) * 100).otherwise(acc["part"] + n)
        return F.struct(total.cast("long").alias("total"), part.cast("long").alias("part"))

    known = F.forall(words, lambda w: F.array_contains(F.array(*[F.lit(w2) for w2 in (*NUMBER_WORDS, *SCALES, "hundred")]), w)) & (F.size(words) > 0)
    return F.when(known, F.aggregate(words, zero, step, lambda a: a["total"] + a["part"]).cast("string")).otherwise(t)


def vector_matrix(x) -> Column:
    """Braced lists as LaTeX column matrices, joined by commas."""
    found = F.regexp_extract_all(strip(x), F.lit(r"(\{.*,.*\})"), F.lit(1))
    one = lambda m: F.concat(F.lit("\\begin{pmatrix}"), F.replace(F.regexp_replace(m, r"^[{}]+|[{}]+$", ""), F.lit(","), F.lit("\\")), F.lit("\\end{pmatrix}"))
    return F.array_join(F.transform(found, one), ", ")


def clip_end(x, mark: str) -> Column:
    """A text that ends with an end mark, without the last one; any other text unchanged."""
    t = _c(x)
    return F.when(t.endswith(mark), F.substring(t, F.lit(1), F.length(t) - len(mark))).otherwise(t)


def metric_label(x) -> Column:
    """A metric's name for reading: its prefix spelled out."""
    m = _c(x)
    out = F.when(F.lit(False), m)
    for prefix, label in (("rm::", "RM: "), ("pu_", "PU: "), ("eff_", "EFF: "), ("bt_", "BT: "), ("red_", "RED: ")):
        out = out.when(m.startswith(prefix), F.concat(F.lit(label), F.substring(m, F.lit(len(prefix) + 1), F.length(m))))
    return out.otherwise(m)


def model_size(name) -> Column:
    """Billions of parameters that a model's name states last; null if none."""
    return F.try_element_at(F.regexp_extract_all(F.lower(_c(name)), F.lit(r"(\d+\.?\d*)b"), F.lit(1)), F.lit(-1)).try_cast("double")


def default_config(name) -> Column:
    """Which default generation config serves a model without its own: large above 50 billion, else small."""
    return F.when(model_size(name) > 50, "default_large").otherwise("default_small")


def fuzzy_key(x) -> Column:
    """A name in lower case with every separator as an underscore."""
    return F.translate(F.lower(_c(x)), "/ -.:", "_____")


def same_teacher(name, wanted: str) -> Column:
    """Whether a name is the wanted one or holds it, whatever the separators."""
    return F.contains(fuzzy_key(name), fuzzy_key(F.lit(wanted)))


def color_slot(name, slots: int = 360) -> Column:
    """A stable place on the colour wheel for a name that has no colour of its own."""
    return F.pmod(F.xxhash64(F.lower(_c(name))), F.lit(slots)).cast("int")


#: The question of a choice among four, and what follows a partial trace.
CHOICE_PROMPT = """What is the correct answer to this question: {}
Choices:
A. {}
B. {}
C. {}
D. {}

Based on the above, what is the single, most likely answer choice? Reason step by step. Format your final answer as follows: "The correct answer is \\boxed{{X}}"
"""
FOLLOW_UP = {"math": "\nThe answer is \\boxed", "gpqa": "\nThe answer is \\boxed", "connections": "\nMy final groupings are:\n```{"}


def choice_prompt(question, *choices) -> Column:
    """The prompt of a question with four choices."""
    parts, values, out = CHOICE_PROMPT.replace("{{X}}", "{X}").split("{}"), [_c(question), *map(_c, choices)], []
    for text_, value in zip(parts, [*values, None]):
        out += [F.lit(text_)] + ([value] if value is not None else [])
    return F.concat(*out)


def with_follow_up(x, dataset) -> Column:
    """A partial trace without its end mark, with what makes a student state its answer."""
    tail = F.lit("")
    for name, value in FOLLOW_UP.items():
        tail = F.when(F.lower(_c(dataset)).contains(name), F.lit(value)).otherwise(tail)
    return F.concat(_c(x), tail)


#: Families of models, in the order in which a name is tried.
FAMILIES = ("gpt-oss", "deepseek", "qwen", "qwq", "magistral", "gemma", "llama", "openreasoning", "phi")


def family(name) -> Column:
    """The first family that a model's name holds, else its own colour slot."""
    out = F.when(F.lit(False), F.lit(""))
    for f in FAMILIES:
        out = out.when(F.lower(_c(name)).contains(f), F.lit(f))
    return out.otherwise(F.concat(F.lit("slot "), color_slot(name).cast("string")))
