from tamarack.cli import main

raise SystemExit(main())
