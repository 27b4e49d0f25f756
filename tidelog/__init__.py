"""tidelog: semantic search and lifecycle management of agent conversation logs on Spark."""

__version__ = "0.1.0"
