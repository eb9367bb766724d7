"""Requests to models as columns: paraphrases, outlines, drafts and few-shot rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What models are asked for, in the words that training and serving share.
INSTRUCTION, AUTHOR = "把下面这段文字改写成{name}的文风，内容和顺序不变。", "作者"
PARAPHRASE = {
    "default": "在不改变顺序和逻辑的前提下，用你自己最舒适、最自然的语言风格重写下面这段文字。",
    "formal": "把下面这段文字改写成适合正式发表的书面文章段落，措辞规范、表达严谨。",
    "style_mimic": "下面先给出两段示例文字，请模仿示例的文风（用词、句式、节奏），重写后面的目标段落。",
    "expand": "对下面这段文字进行润色，让表达更完整、更流畅，补足句子之间的过渡和衔接，使读者更容易理解。",
    "condense": "把下面这段文字改写得更简洁、更专业，去掉口语化的表达。",
}
PARAPHRASE_RULES = "要求：保留原文的全部信息、观点和先后顺序，不增加原文没有的事实、数字或例子，不删掉任何论点；如果原文是列表，保持列表形式。只输出改写后的正文，不要标题、不要解释、不要引号。"
EXTRACT = (
    "阅读下面这一节文章。先按原文顺序列出它的要点，每个要点一行，只概括意思，不要照抄原句；再列出其中出现的全部具体事实：数字、人名、机构名、产品名、书名、例子、引语，一项一行，照原文写。\n"
    "只输出下面的格式，不要别的内容：\n要点：\n1. ……\n事实：\n- ……"
)
DRAFT = {
    "draft_default": "下面是一节文章的要点和事实清单。请据此写出这一节的正文，约 {n} 字。用你自己最自然的写法，自己决定怎么分段、怎么组织。",
    "draft_style": "下面先给出两段示例文字，然后是一节文章的要点和事实清单。请模仿示例的文风（用词、句式、节奏），据此写出这一节的正文，约 {n} 字，自己决定怎么分段、怎么组织。",
    "draft_formal": "下面是一节文章的要点和事实清单。请据此写出这一节适合正式发表的正文，约 {n} 字，措辞规范、表达严谨，自己决定怎么分段、怎么组织。",
}
DRAFT_RULES = "要求：只能使用清单里的事实，不要增加清单以外的数字、人名、机构或例子；要点都要写到；不要标题，不要解释，只输出正文。"
FEW_SHOT = (
    "下面是{name}写的几段原文。先仔细体会他的文风：用词、句式、语气、节奏、口语化程度。",
    "然后把后面的目标段落改写成{name}的文风。要求：保留全部信息、观点和先后顺序，不增加原文没有的事实，不要照抄例子里的内容。只输出改写后的正文，不要解释。",
)


def instruction(name: str = AUTHOR, template: str = INSTRUCTION) -> str:
    return template.format(name=name)


def chosen(texts: dict[str, str], prompt: Column) -> Column:
    """The text of a prompt id; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), prompt)


def exemplified(rows: DataFrame, pool: DataFrame, prompt: str, mimic: str, unit: str = "unit_id") -> DataFrame:
    """rows with `exemplars`: for the prompt `mimic` two texts of the pool (text), chosen by a hash of the unit; else null. The pool is a few files' paragraphs.

    Texts are numbered once; a unit takes the one its hash falls on and another one at a distance that its hash tells.
    """
    texts = [r.text for r in pool.select("text").distinct().orderBy("text").collect()]
    n = len(texts)
    if n < 2:
        if rows.where(F.col(prompt) == mimic).limit(1).count():
            raise ValueError(f"{mimic} needs at least two exemplars")
        return rows.withColumn("exemplars", F.lit(None).cast("array<string>"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", unit, F.lit(mimic))), 1, 12), 16, 10).cast("long")
    first = F.pmod(h, F.lit(n))
    second = F.pmod(first + 1 + F.pmod(F.floor(h / n), F.lit(n - 1)), F.lit(n))
    held = F.array(*map(F.lit, texts))
    return rows.withColumn("exemplars", F.when(F.col(prompt) == mimic, F.array(F.get(held, first.cast("int")), F.get(held, second.cast("int")))))


def examples_block(exemplars: Column) -> Column:
    return F.when(exemplars.isNotNull(), F.concat(F.lit("【示例一】\n"), exemplars[0], F.lit("\n\n【示例二】\n"), exemplars[1]))


def paraphrase(prompt: Column, text: Column, previous: Column, exemplars: Column) -> Column:
    before = F.when(previous != "", F.concat(F.lit("【上文，仅帮助理解语境，不要改写、不要输出】\n"), previous))
    return F.concat_ws("\n\n", chosen(PARAPHRASE, prompt), F.lit(PARAPHRASE_RULES), examples_block(exemplars), before, F.concat(F.lit("【需要改写的段落】\n"), text))


def extract(text: Column) -> Column:
    return F.concat(F.lit(f"{EXTRACT}\n\n【文章】\n"), text)


def draft(prompt: Column, text: Column, outline: Column, exemplars: Column) -> Column:
    asked = F.replace(chosen(DRAFT, prompt), F.lit("{n}"), F.length(text).cast("string"))
    return F.concat_ws("\n\n", asked, F.lit(DRAFT_RULES), examples_block(exemplars), F.concat(F.lit("【要点与事实】\n"), outline))


def few_shot(name: str, text: Column, previous: Column, examples: Column) -> Column:
    """examples: array of the author's texts, numbered from 1."""
    shown = F.array_join(F.transform(examples, lambda e, i: F.concat(F.lit("【例"), (i + 1).cast("string"), F.lit("】\n"), e)), "\n\n")
    before = F.when(previous != "", F.concat(F.lit("【上文，仅供参考，不要改写】\n"), previous))
    head, rules = (F.lit(x.format(name=name)) for x in FEW_SHOT)
    return F.concat_ws("\n\n", head, shown, rules, before, F.concat(F.lit("【目标段落】\n"), text))


def generation_budget(text: Column, factor: int = 3, extra: int = 200, most: int = 2048) -> Column:
    return F.least(F.lit(most), factor * F.length(text) + extra)
