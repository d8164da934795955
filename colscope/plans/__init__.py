"""Actions, the facade, and all queries."""
