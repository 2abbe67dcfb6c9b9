"""Prompts as templates with named slots, in wording of our own, and what replies to them must hold.

A reply format that the parsers rely on is part of its template.  Slots are filled by text.prompt: a null is empty, a value
never opens another slot.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom.functions.sections import EXTEND
from qaloom.functions.text import prompt

_POINTS = "Question: {question}\nKnown points:\n{points}\nDocument:\n{doc}\n"
_SCORED = "Question: {question}\nRight answer:\n{answer}\nPrediction:\n{prediction}\n"
_REPLY = "Reply with lines Question:, Answer: (a bullet a point) and, for each document, \"Document n Title:\" and its points as bullets."
_FUNCTION = "Reply with Parameters:, Objectives:, a line 'Function \"name\" in file \"file.py\":', imports and the definition."
_PROBLEM = "Reply with Parameters:, Objectives:, Return Values:, a line 'Function name in file.py:', imports and the definition."

TEMPLATES: dict[str, dict[str, str]] = {
    "verify": {
        "presence": "Question: {question}\nPoint: {point}\nDocument:\n{doc}\nReply with Presence:, Explanation for Presence:, Relevance:, Explanation for Relevance:.",
        "presence_type3": "Question: {question}\nPoint: {point}\nDocument:\n{doc}\nReply with Presence:, Explanation for Presence:, Absence of Conclusion:, Explanation for Absence:.",
        "predict": "Question: {question}\nDocument:\n{doc}\nAnswer from the document alone, or say that there is no relevant information found in this document.",
        "compare": "Question: {question}\nKnown points:\n{points}\nAnswer:\n{answer}\nTrue or False: does the answer go beyond them?  Then Extra Points Mentioned:.",
        "extra": _POINTS + "True or False: does the document hold further points that answer the question?  Then Extra Points Mentioned:.",
        "extra_type3": _POINTS + "True or False: does the document state a conclusion or further evidence?  Then Extra Points Mentioned:.",
        "extra_adv": "Question: {question}\nDocument:\n{doc}\nTrue or False: does it hold points that answer the question?  Then Relevant Points:.",
        "remove": _POINTS + "Write the document again without this, and change nothing else:\n{info}",
        "add": "Question: {question}\nDocument:\n{doc}\nWrite the document again with this in it, and change nothing else:\n{info}",
        "cross_check": "Question: {question}\nPoint: {point}\nReply with Relevance: True or False.",
        "grounding": "Question: {question}\nSource:\n{source}\nAnswer:\n{answer}\nReply with Grounded:, Flagged Point:, Corrected Point:.",
        "topic": "Persona: {persona}\nEnvironment: {environment}\n{source}\nQuestion: {question}\nReply with On_Topic: True or False.",
    },
    "evaluate": {
        "basic": _SCORED + "Wrong answers:\n{adversarial}\nBegin with True or False.",
        "step-by-step": _SCORED + "Wrong answers:\n{adversarial}\nDocuments:\n{docs}\nReason in steps and end with FINAL VERDICT: Correct or Wrong.",
        "score": _SCORED + "Begin with a mark from 0 to 10.",
        "causal": _SCORED + "Wrong answers:\n{adversarial}\nThe evidence and its link to the conclusion must both stand.  Begin with True or False.",
    },
    "solve": {
        "basic": "Documents:\n{docs}\nQuestion: {question}\nAnswer from the documents, a bullet a point.",
        "no-irrelevant": "Documents:\n{docs}\nQuestion: {question}\nAnswer from the documents, a bullet a point, and nothing that the question doesn't ask for.",
    },
    "generate": {
        "scenarios": "Scenarios so far:\n{scenarios}\nAreas:\n{areas}\nWrite more, each as USER_PERSONA:, COLLECTION_OF_DOCS:, REGULATORY_AREA_ID:.",
        "qa_type1": "Persona: {persona}\nEnvironment: {environment}\nSource:\n{source}\nEarlier questions:\n{prior}\nA question whose answer lies in several documents.  " + _REPLY,
        "qa_type2": "Persona: {persona}\nEnvironment: {environment}\nSource:\n{source}\nEarlier questions:\n{prior}\nA question of conditions that documents state apart.  " + _REPLY,
        "qa_type3": "Persona: {persona}\nEnvironment: {environment}\nSource:\n{source}\nEarlier questions:\n{prior}\nA question that asks for evidence and a conclusion.  " + _REPLY,
        "qa_numeric": "Persona: {persona}\nEnvironment: {environment}\nFigures:\n{source}\nEarlier questions:\n{prior}\nBegin with Calculation: and lines 'Step n: what = expression = value'.  " + _REPLY,
        "adversarial": "Persona: {persona}\nEnvironment: {environment}\nQuestion: {question}\nAnswer:\n{answer}\nEarlier ones:\n{prior}\nA question that looks alike and has another answer.  " + _REPLY,
        "documents": "Persona: {persona}\nEnvironment: {environment}\nQuestion: {question}\nPoints:\n{points}\nNot to be answered:\n{adversarial}\nWrite the documents: Document n:, Title:, Text:.",
        "naive": "{examples}\nWrite another one: Documents:, Question:, Answer:.",
    },
    "judge": {
        "checklist": "Question: {question}\nAnswer:\n{answer}\nWrite numbered criteria that a right answer meets.",
        "grading": "Question: {question}\nAnswer:\n{answer}\nPrediction:\n{prediction}\nCriteria:\n{criteria}\nFor each write its number and Yes, No or Unsure.",
    },
    "code": {
        "solve": "Codebase:\n{context}\nProblem:\n{problem}\nWrite the function.",
        "execution_check": "Function:\n{function}\nWrite a test that calls it and asserts what it returns.",
        "test": "Codebase:\n{context}\nProblem:\n{problem}\nFunction:\n{function}\nWrite a test that asserts its return values.",
        "verify": "Codebase:\n{context}\nProblem:\n{problem}\nWrite the function from its description.",
        "modify": "Problem:\n{problem}\nFunction:\n{function}\nFailed as:\n{output}\nPut the problem's description right.",
        "helpers": "Domain: {domain}\nFunctions so far:\n{functions}\nWrite more.  " + _FUNCTION,
        "problem": "Functions:\n{functions}\nA problem that calls several of them.  " + _PROBLEM,
        "problem_small": "Functions:\n{functions}\nA short problem that calls two of them.  " + _PROBLEM,
    },
    "math": {
        "solve": "{examples}\nQuestion: {question}\nReason, then write: The answer is <number>.",
        "solve_plain": "Question: {question}\nReason, then write: The answer is <number>.",
        "solve_sentence": "{examples}\nQuestion: {question}\nA sentence a step, then: The answer is <number>.",
        "banned": "Text: {text}\nNumbers: {numbers}\nTrue or False: does the text give one of them away?",
        "grammar": "Context 1: {first}\nContext 2: {second}\nContext 3: {third}\nReply with Corrected context 1:, 2: and 3:.",
        "extend": "Context: {context}\nQuestion: {question}\nAnswer: {answer}\nAsk on from the answer.  Reply with " + " ".join(m[0] for m in EXTEND.values()),
        "extend_small": "Context: {context}\nQuestion: {question}\nAnswer: {answer}\nAsk on from the answer in short sections: " + ", ".join(m[-1] for m in EXTEND.values()),
        "naive": "{examples}\nWrite another one: Rewritten problem:, New answer:.",
    },
}


def filled(kind: str, name: str, **slots: Column | str) -> Column:
    """A template with its slots; one without a value is an error."""
    template = TEMPLATES[kind][name]
    columns = {n: F.lit(v) if isinstance(v, str) else v for n, v in slots.items()}
    lacking = [p for p in {part.split("}")[0] for part in template.split("{")[1:]} if p not in columns]
    if lacking:
        raise KeyError(f"{kind}/{name} lacks {sorted(lacking)}")
    return prompt(template, columns)
