"""Text for language models from bar tables, and tools they can call."""

from .text import context, schema, summarize
from .tools import execute_tool, tools

__all__ = ["summarize", "context", "schema", "tools", "execute_tool"]
