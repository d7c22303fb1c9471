"""Prompt templates with {query} and {content} slots; literal braces are doubled."""

PRUNER = """You are given numbered pieces of a web page, each with its place in the page.
Pick the pieces that help to answer the request, in the order of their use.

Request: {query}

{content}

Reply with nothing but a JSON list of the numbers, for instance [0, 3]; [] if no piece helps.
"""

QA = """Answer the question from the page below and from nothing else.
Use the page's own words. Answer yes or no to a question of yes or no.

Question: {query}

Page:
{content}

Reply with one JSON object: {{"answer": "..."}}; null if the page does not say.
"""

SCHEMA = """Fill in the fields of the schema from the page below.
Copy each value from the page as it stands there; null for a field that the page does not give.

Schema: {query}

Page:
{content}

Reply with one JSON object that has the schema's fields, such as {{"field": "value"}}.
"""
