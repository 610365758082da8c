"""What a query text asks for: relation, task, finer intent and preferred sources, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases that tell a relation, a task or a finer intent; all over lower-case text unless said otherwise.
CALLEES = [r"\bwhat\s+does\s+.+\s+call\b", r"\bwhat\s+does\s+.+\s+depend\s+on\b", r"\bwhat\s+does\s+.+\s+import\b", r"\bcallees?\s+of\b"]
CALLERS = [r"\b(?:what|who)\s+calls?\b", r"\bcallers?\s+of\b", r"\b(?:what|who)\s+uses?\b", r"\bwhere\s+is\s+.+\s+used\b", r"\bwhere\s+is\s+.+\s+called\b", r"\bwhat\s+depends\s+on\b", r"\bwhat\s+imports?\b", r"\busages?\s+of\b", r"\breferences?\s+to\b", r"\bcall\s+sites?\b"]
TARGETS = [r"(?i)\b(?:what|who)\s+calls?\s+(.+)$", r"(?i)\bcallers?\s+of\s+(.+)$", r"(?i)\b(?:what|who)\s+uses?\s+(.+)$", r"(?i)\bwhere\s+is\s+(.+?)\s+used$", r"(?i)\bwhere\s+is\s+(.+?)\s+called$", r"(?i)\bwhat\s+depends\s+on\s+(.+)$", r"(?i)\bwhat\s+imports?\s+(.+)$", r"(?i)\busages?\s+of\s+(.+)$", r"(?i)\breferences?\s+to\s+(.+)$", r"(?i)\bcall\s+sites?\s+(?:of|for)\s+(.+)$", r"(?i)\bwhat\s+does\s+(.+?)\s+call$", r"(?i)\bwhat\s+does\s+(.+?)\s+depend\s+on$", r"(?i)\bwhat\s+does\s+(.+?)\s+import$", r"(?i)\bcallees?\s+of\s+(.+)$"]
TESTS = [r"\b(?:failing|broken)\s+tests?\b", r"\btest failure\b", r"\bwhat does\s+.+\s+test\b", r"\btests?\s+for\b", r"\bwhat tests?\s+cover\b", r"\bwhere are(?:\s+the)?\s+.+\s+tests?\b", r"\btest(?:s)?\s+(?:cover|covers|covering)\b"]
BUGS = [r"\bexpected behavior\b", r"\bactual behavior\b", r"\bsteps to reproduce\b", r"\breproduction\b"]
#: over single lines as written
ERROR_LINES = [r"^at\s+\S+", r"(?i)^(error|err|e)\w*\d{2,}", r"\b(?:TypeError|ReferenceError|SyntaxError|RangeError|AssertionError|RuntimeError|\w+Exception)\b"]
IMPLEMENTATION = [r"\b(?:function|method|helper|factory|routine|implementation|defined|wrap|wraps|return|returns|create|creates|parse|parses|read|reads|call|calls|build|builds|implemented|singleton)\b", r"\bexported\s+that\b", r"\bbootstraps?\s+from\b", r"\bthe\s+object\s+that\s+every\b"]
DECLARATIVE = [r"\b(?:what|which)\s+type\b", r"\binterface\s+(?:for|of)\b", r"\bschema(?:\s+shape)?\s+(?:for|of)?\b", r"\bshape\s+of\b", r"\bcontract\s+(?:for|of)\b", r"\brepresents?\b"]
BRIDGES = [r"\bwhich\s+.+\s+handler\s+(?:bridges|forwards|wraps|awaits)\b", r"\bwhich\s+.+\s+adapter\b", r"\bwhich\s+.+\s+link\s+reads\b", r"\bwhich\s+.+\s+entrypoint\s+forwards\b", r"\bwhat\s+.+\s+handler\s+closure\b", r"\bwhat\s+.+\s+handler\s+bridges\b", r"\bwhat\s+exported\s+.+\s+entrypoint\b", r"\bwhat\s+async\s+generator\s+helper\b"]
BUG_OWNERS = [r"\bwhy\s+does\b", r"\bwhat\s+causes\b", r"\bwhy\s+is\b.+\bnot\s+working\b", r"\bwhere\s+does\b.+\bgo\s+wrong\b", r"\bwhy\b.+\bfail(?:ing|s|ed)?\b", r"\bfind\s+the\s+code\s+responsible\s+for\b", r"\bfind\s+the\s+code\s+path\s+that\b", r"\bfind\s+the\b.+\bbug\b", r"\bfind\s+the\s+code\s+that\s+makes\b", r"\bfind\s+the\b.+\blogic\b.+\bshould\b", r"\bfallback\s+bug\b", r"\bleaking\s+.+\bfrom\s+another\s+branch\b", r"\breads?\b.+\binstead\s+of\b", r"\btransient\s+lock\s+contention\b"]
BUG_SOURCES = [r"\bwhere\s+does\b.+\bthrow\b", r"\bwhere\s+does\s+bootstrapping\b", r"\bwhere\s+does\s+merging\b", r"\bwhere\s+does\s+shallow\b", r"\bwhere\s+does\s+the\s+plain\b", r"\bwhere\s+does\s+the\s+eventsource\b"]
DISCOVERY = [r"\bwhat\s+tests?\s+cover\b", r"\btests?\s+for\b", r"\bspecs?\s+for\b", r"\bshow\s+me\s+the\s+tests?\s+covering\b", r"\bshow\s+me\s+the\b.+\btests?\b", r"\b(?:integration\s+)?tests?\s+exercise\b", r"\btests?\s+validate\b", r"\bwhere\s+are(?:\s+the)?\s+.+\s+tests?\b", r"\bcoverage\b"]
WORKINGS = [r"\bwhere\s+does\s+the\s+(?:framework|runtime|server|client|system)\b", r"\bwhere\s+are\s+.+\s+processed\b", r"\bwhere\s+does\s+.+\s+get\b", r"\bwhere\s+do\s+.+\s+get\b", r"\bhow\s+does\b", r"\bhow\s+is\b.+\bhandled\b", r"\bwhere\s+are\s+periodic\b", r"\bwhere\s+are\s+.+\s+merged\b", r"\bwhat\s+implements\b", r"\bwhere\s+is\b.+\bimplemented\b", r"\bimplementation\s+of\b", r"\bhow\b.+\bwork\b", r"\bfind\s+the\s+(?:tool|function|code)\s+that\b", r"\bwhat\s+function\s+writes\b", r"\bwhich\s+file\s+implements\b", r"\bwhich\s+tool\s+returns\b", r"\bwhich\s+tool\s+streams?\b"]
OWNERS = [r"\bwhat\s+handles\b", r"\bwhat\s+owns\b", r"\bwhat\s+manages\b", r"\bwhat\s+is\s+responsible\s+for\b", r"\bwhich\s+(?:component|module|service)\b.+\bhandles\b", r"\bwhich\s+file\s+owns\b", r"\bwhich\s+file\s+is\s+responsible\s+for\b"]
CONFIG_FRAMES = [r"\b(?:where|show\s+me\s+where)\b.+\bdefined\b", r"\bwhat\s+is\s+the\s+default\b"]
CONFIG_SIGNS = [r"\bconfig\b", r"\bdefault\b", r"\b(?:fusionstrategy|hybridweight|rrfk|reranktopn)\b", r"\b(?:sqlite_busy_timeout_ms|arctic_query_prefix|voyage_default_model_id)\b"]
SOURCE_WORDS = "implement implementation implements function method class logic algorithm pipeline indexer".split()
SOURCE_HINTS = "implement implementation function method class logic algorithm pipeline indexer where".split()
DOC_TEST_HINTS = "test tests fixture fixtures benchmark readme docs documentation".split()
DOC_HINTS = "readme docs documentation guide usage".split()
TEST_HINTS = "test tests fixture fixtures benchmark".split()
# The task of each kind of evaluation query.
TASK_OF_KIND = {"definition": "definition", "implementation-intent": "definition", "config-constant-lookup": "definition", "config-lookup": "definition", "cross-file-relationship": "definition", "test-discovery": "test_debug", "bug-report": "bug", "bug-error-lookup": "bug", "identifier-heavy": "general", "keyword-heavy": "general", "similarity": "semantic", "file-intent": "semantic", "concept": "semantic"}


def has(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def relation(query: Column) -> Column:
    """callee, caller or null."""
    low = F.lower(F.trim(query))
    return F.when(has(low, CALLEES), "callee").when(has(low, CALLERS), "caller")


def relation_target(query: Column) -> Column:
    """The phrase a relation is about, without quotes and punctuation around it; null without one."""
    text = F.trim(query)

    def clean(raw: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^[`\"'(\[{<\s]+", ""), r"[`\"')\]}>?,.;:!\s]+$", "")
        return F.when(out != "", out)

    return F.coalesce(*[clean(F.regexp_extract(text, p, 1)) for p in TARGETS])


def error_lines(query: Column) -> Column:
    """Whether some line looks like one of a stack trace or an error message."""
    lines = F.transform(F.split(query, r"\r?\n"), lambda x: F.trim(x))
    return F.exists(lines, lambda x: (x != "") & has(x, ERROR_LINES))


def should_but(query: Column) -> Column:
    """'should ... but' with at most 80 characters from one to the other."""
    low = F.lower(query)
    should = F.locate("should", low)
    but = F.call_function("locate", F.lit("but"), low, should + F.lit(6))
    return (should > 0) & (but > 0) & (but - should <= 80)


def test_signals(query: Column) -> Column:
    low = F.lower(query)
    asked = query.rlike(r"\?") | low.rlike(r"^\s*(?:what|where|which|how|why)\b")
    return has(low, TESTS) | (low.rlike(r"\bcoverage\b") & low.rlike(r"\b(?:test|tests|spec|specs|cover|covers|covering)\b")) | (asked & low.rlike(r"\b(?:describe|it block|beforeeach)\b"))


def task_type(query: Column) -> Column:
    """definition for relations, test_debug, bug or general; semantic only comes from the caller."""
    bug = has(F.lower(query), BUGS) | error_lines(query) | should_but(query)
    return F.when(relation(query).isNotNull(), "definition").when(test_signals(query), "test_debug").when(bug, "bug").otherwise("general")


def task_of_kind(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TASK_OF_KIND.items() for x in kv]), kind)


def seeks_implementation(query: Column) -> Column:
    return has(F.lower(query), IMPLEMENTATION)


def sub_intent(query: Column, task: Column) -> Column:
    """One of nine finer intents, or null."""
    low = F.lower(query)
    declared = has(low, DECLARATIVE) | (low.rlike(r"\b(?:config|configuration|options?|params?|props?)\b") & low.rlike(r"\b(?:type|interface|schema|shape|represents?)\b"))
    framed = low.rlike(r"\bwhere\s+is\b.+\bdefined\b") | (low.rlike(r"^\s*where\s+is\s+the\b") & low.rlike(r"\bdefined\s*$"))
    source = error_lines(query) | query.rlike("[`\"'“”][^`\"'“”]{3,}[`\"'“”]") | has(low, BUG_SOURCES) | (low.rlike(r"\b(?:throws?|exception|error(?:\s+message)?)\b") & query.rlike(r"\b(?:[A-Z][A-Za-z0-9]+(?:Error|Exception)|[a-z_]+error)\b"))
    wide = task.isin("general", "semantic")
    definition = task == "definition"
    sought = seeks_implementation(query)
    return (
        F.when(F.trim(query) == "", F.lit(None).cast("string"))
        .when(wide & has(low, CONFIG_FRAMES) & has(low, CONFIG_SIGNS), "definition:declarative")
        .when(definition & framed & sought, "definition:executable")
        .when(definition & (relation(query) == "caller"), "relationship:caller")
        .when(definition & ((relation(query) == "callee") | has(low, BRIDGES)), "relationship:callee")
        .when(definition & sought, "definition:executable")
        .when(definition & declared, "definition:declarative")
        .when((task == "bug") & source, "bug:error-source")
        .when((task == "bug") & has(low, BUG_OWNERS), "bug:behavior-owner")
        .when((task == "test_debug") & has(low, DISCOVERY), "test:discovery")
        .when(wide & has(low, OWNERS), "concept:architecture")
        .when(wide & has(low, WORKINGS), "concept:implementation")
    )


def _words_in(text: Column, words: list[str]) -> Column:
    return sum((text.rlike(rf"\b{w}\b").cast("int") for w in words), F.lit(0))


def _tokens_in(tokens: Column, words: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*words)))


def source_intent(query: Column, tokens: Column, hints: Column) -> Column:
    """source or doc_test: by whole words, then by 'where is' with an identifier, then by the ranking tokens (ties: source)."""
    low = F.lower(query)
    docs, source = _words_in(low, DOC_TEST_HINTS), _words_in(low, SOURCE_WORDS)
    token_docs, token_source = _tokens_in(tokens, DOC_TEST_HINTS), _tokens_in(tokens, SOURCE_HINTS)
    return F.when(docs > source, "doc_test").when(source > docs, "source").when(low.rlike(r"\bwhere\s+is\b") & (F.size(hints) > 0) & (docs == 0), "source").when(token_source >= token_docs, "source").otherwise("doc_test")


def doc_intent(tokens: Column) -> Column:
    docs, tests = _tokens_in(tokens, DOC_HINTS) > 0, _tokens_in(tokens, TEST_HINTS) > 0
    return F.when(docs & ~tests, "docs").when(tests & ~docs, "test").when(docs | tests, "mixed").otherwise("none")
