"""Reading stored log lines, and the incident tables that runs read and write."""
