from tallgrass.api import main

main()
