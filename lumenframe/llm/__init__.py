"""Training-data operators: text, URL, HTML and audio columns at corpus scale.

Nothing outside this subpackage imports it.  ``lumenframe.llm.queries`` holds the registered queries.
"""
