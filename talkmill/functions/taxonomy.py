"""The ordered keyword taxonomy and the two marker lists.

The taxonomy is a parameter of every operator that scores text; ``DEFAULT`` is
the one used when none is given.  Order carries meaning: on equal scores the
earlier category (and the earlier subcategory) wins, and inside one group the
earlier keyword wins at the same position.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# Category | subcategory (empty for the category's own keywords) | keywords.
FIXED_TAXONOMY = """
Learning/Education | | explain, teach, learn, understand, what is, how does, define, example, tutorial, forklar, forklaring, forstå, lær, hvordan
Learning/Education | Concept Understanding | what is, define, concept, mean, forklar, hvad er
Learning/Education | How-to Learning | how to, steps, guide, tutorial, hvordan
Learning/Education | Problem Solving | solve, solution, answer, help me understand
Learning/Education | Academic Topics | method, theory, model, metode, teori, analyse
Code Development | | code, program, function, debug, error, python, javascript, api, database, git
Code Development | Bug Fixing | error, bug, fix, issue, debug
Code Development | Feature Development | create, implement, develop, add feature
Code Development | Code Review | review, improve, optimize, refactor
Writing Assistance | | write, draft, review, proofread, text, article, edit, grammar
Writing Assistance | Content Creation | write, create, draft
Writing Assistance | Editing | edit, proofread, review, improve
Writing Assistance | Format/Style | format, style, structure
Analysis/Research | | analyze, research, study, investigate, compare, evaluate, data, findings
Analysis/Research | Data Analysis | data, statistics, numbers, trends
Analysis/Research | Research Review | research, paper, study, literature
Analysis/Research | Comparative Analysis | compare, difference, versus, pros and cons
Creative & Ideation | | create, design, generate, brainstorm, imagine, creative, innovative, idea, suggest, think of, come up with, possibilities, concept
Creative & Ideation | Visual Design | design, visual, layout, look
Creative & Ideation | Idea Generation | brainstorm, ideas, possibilities, suggest
Creative & Ideation | Creative Problem Solving | solution, solve, address, improve
Creative & Ideation | Innovation | innovative, new, unique, original
Creative & Ideation | Concept Development | develop, refine, enhance, iterate
Professional/Business | | business, professional, company, client, strategy, market, industry
Professional/Business | Strategy | strategy, plan, approach
Professional/Business | Client/Customer | client, customer, service
Professional/Business | Business Analysis | analysis, market, industry
Technical Support | | help, fix, issue, problem, support, error, troubleshoot, sync, synch, calendar, setup, connect, integration, configure, settings, apple, microsoft, teams, outlook
Technical Support | Troubleshooting | troubleshoot, diagnose, fix, issue, error
Technical Support | Setup/Installation | setup, install, configure, connect, sync
Technical Support | Usage Help | how to use, help with, guide, how do i
Technical Support | Integration Issues | sync, connect, integration, between, with
Personal Projects | | project, personal, help me with, my own, portfolio, hobby
Personal Projects | Project Planning | plan, structure, organize
Personal Projects | Implementation | build, create, develop
Personal Projects | Review/Feedback | review, feedback, improve
SoMe/Marketing | | social media, marketing, post, content, campaign, LinkedIn, Twitter, engagement, opslag, sæson, hold, announce, announcement, season, team, group, start
SoMe/Marketing | Content Creation | post, content, create, opslag, write post
SoMe/Marketing | Event Announcements | season, sæson, event, start, announce, new
SoMe/Marketing | Team/Group Updates | team, hold, group, members, community
SoMe/Marketing | Campaign Planning | campaign, strategy, plan, theme, tema
DALL-E/Image | | image, picture, photo, generate image, create image, dall-e, dalle, draw, illustration, visual, artwork
DALL-E/Image | Image Generation | generate, create, make
DALL-E/Image | Image Editing | edit, modify, adjust
DALL-E/Image | Style Transfer | style, artistic, filter
DALL-E/Image | Visual Description | describe, detail, explain image
Cooking/Food | | food, cook, recipe, ingredient, meal, dish, kitchen, bake, pumpkin, vegetable, fruit, squash, cuisine, eat, dinner, lunch, breakfast
Cooking/Food | Recipe Help | recipe, how to make, cook, bake, prepare
Cooking/Food | Ingredient Questions | ingredient, what is, substitute, alternative
Cooking/Food | Food Identification | what is this, identify, which, type of, variety
Cooking/Food | Meal Planning | meal, plan, menu, dinner, lunch, breakfast
Information/Curiosity | | what is, where is, why does, how does, tell me about, find information, information about, can you find, explain why, hvorfor, hvor, hvad, find ud af, finde information, information om
Information/Curiosity | General Knowledge | what is, tell me about, explain, fortæl
Information/Curiosity | Location/Place Questions | where is, location, place, hvor
Information/Curiosity | Cause/Effect | why does, how does, what causes, hvorfor
Information/Curiosity | Research Requests | find information, research, look up, find ud af, søg
Information/Curiosity | Industry/Topic Research | industry, sector, field, branche, område, digitalization, digitalisering
"""

# Words that mark a voice conversation.
VOICE_KEYWORDS = "transcript, audio, voice, speech, spoken, recording, sound".split(", ")

# Danish marker words.
DANISH_MARKERS = (
    "hvordan, hvad, hvilken, hvor, hvem, hvorfor, skriv, hjælp, tak, opslag, sæson, hold, "
    "med, og, eller, på, jeg, du, vi, denne"
).split(", ")

# Labels of a text without any keyword hit.
NO_CATEGORY = "Other"
NO_SUBCATEGORY = "Uncategorized"

MAX_TAXONOMY_ROWS = 20_000

TABLE_SCHEMA = (
    "cat_ord int, category string, sub_ord int, subcategory string, kw_ord int, keyword string"
)


@dataclass(frozen=True)
class Group:
    """One keyword list: a category's own (``subcategory`` is None) or a subcategory's."""

    category: str
    subcategory: str | None
    keywords: tuple[str, ...]


class Taxonomy:
    """Ordered keyword groups.

    ``groups`` lists each category's own group, then its subcategories, category
    by category, whatever order they were given in.
    """

    def __init__(self, groups: Iterable[Group]):
        given = list(groups)
        rank = {c: i for i, c in enumerate(dict.fromkeys(g.category for g in given))}
        self.groups: list[Group] = sorted(
            given, key=lambda g: (rank[g.category], g.subcategory is not None)
        )
        self._check()

    def _check(self) -> None:
        seen: set[tuple[str, str | None]] = set()
        mains = {g.category for g in self.groups if g.subcategory is None}
        for g in self.groups:
            if (g.category, g.subcategory) in seen:
                raise ValueError(f"group given twice: {g.category} / {g.subcategory}")
            seen.add((g.category, g.subcategory))
            if not g.keywords:
                raise ValueError(f"no keywords: {g.category} / {g.subcategory}")
            if g.category not in mains:
                raise ValueError(f"category without keywords of its own: {g.category}")
            for k in g.keywords:
                # The word guard stands in for a word boundary only at a word character.
                if not (_is_word(k[:1]) and _is_word(k[-1:])):
                    raise ValueError(f"keyword must start and end with a word character: {k!r}")

    @cached_property
    def categories(self) -> list[str]:
        return list(dict.fromkeys(g.category for g in self.groups))

    @cached_property
    def keywords(self) -> list[str]:
        return list(dict.fromkeys(k.lower() for g in self.groups for k in g.keywords))

    def main_index(self, category: str) -> int:
        return next(
            i
            for i, g in enumerate(self.groups)
            if g.category == category and g.subcategory is None
        )

    def sub_indexes(self, category: str) -> list[int]:
        return [
            i
            for i, g in enumerate(self.groups)
            if g.category == category and g.subcategory is not None
        ]

    def table(self, spark: SparkSession) -> DataFrame:
        """The taxonomy as rows, one per keyword."""
        rows = []
        for c, category in enumerate(self.categories, 1):
            for s, i in enumerate([self.main_index(category), *self.sub_indexes(category)]):
                g = self.groups[i]
                rows += [
                    (c, category, s, g.subcategory, k, word)
                    for k, word in enumerate(g.keywords, 1)
                ]
        return spark.createDataFrame(rows, TABLE_SCHEMA)

    @classmethod
    def from_table(cls, df: DataFrame, most: int = MAX_TAXONOMY_ROWS) -> Taxonomy:
        """Read a taxonomy kept as rows (see :meth:`table`), at most so many."""
        rows = (
            df.select("cat_ord", "category", "sub_ord", "subcategory", "kw_ord", "keyword")
            .limit(most + 1)
            .collect()
        )
        if len(rows) > most:
            raise ValueError(f"a taxonomy has at most {most} keyword rows")
        lists: dict[tuple[str, str | None], list[str]] = {}
        for r in sorted(rows, key=lambda r: (r["cat_ord"], r["sub_ord"], r["kw_ord"])):
            lists.setdefault((r["category"], r["subcategory"]), []).append(r["keyword"])
        return cls(Group(c, s, tuple(words)) for (c, s), words in lists.items())

    @classmethod
    def from_text(cls, text: str) -> Taxonomy:
        """Read ``category | subcategory | keyword, keyword`` lines."""
        groups = []
        for line in text.strip().splitlines():
            category, subcategory, words = (part.strip() for part in line.split("|"))
            keywords = tuple(w.strip() for w in words.split(","))
            groups.append(Group(category, subcategory or None, keywords))
        return cls(groups)


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


DEFAULT = Taxonomy.from_text(FIXED_TAXONOMY)
