"""Panel forecast evaluation for daily realised variance, written against the DataFrame API."""
