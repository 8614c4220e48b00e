"""Set-at-a-time analytics over data-platform workspaces, on Spark DataFrames."""
