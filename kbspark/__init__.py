"""kbspark: website knowledge bases and chat traffic as Spark jobs, over all tenants at once."""
