"""Where catalogs come from and go to: crawls, captured search pages, snapshots and stores."""
