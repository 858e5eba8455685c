"""Training-data operators over document tables (doc_id, text, lang, source, n_chars).

Every operator takes DataFrames and returns DataFrames. It selects the columns that it
needs first, so extra or clashing columns of its input do no harm. Null texts count as
empty; null ids are carried along.
"""
