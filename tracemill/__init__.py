"""Spark jobs over repeated-trial signal traces, and training-data operators beside them (``tracemill.llm``)."""
