"""Rules over one text that need a stack or a cursor: spans, protection, chunking, validation, repair.

Plain Python over strings; the operators run them in Arrow batches. Positions are characters.
"""
