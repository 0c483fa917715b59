"""The corpus pipeline's entry; its body is part of the llm subpackage."""

from kindred.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
