"""Query operators over the commercial tables and the findings."""
